"""SentencePiece BPE models: exact encoding by backtracking, and decoding.

A model of this type merges neighbours whose union is a piece, the best score first, then the leftmost.  A cut of a text into tokens
is what these merges give if and only if every two neighbours, merged anew by themselves, come out as the same two tokens: the first
merge over a border would have to be the best of the two tokens' own, too.  So an encoder need not simulate the merges.  It takes at each
place the longest piece there (one Aho-Corasick pass finds them), checks it against the token before, tries shorter pieces
when they do not fit, and steps back when none does; a bit for each place remembers from where the rest cannot be reached, so no
place fails twice.

Where no piece holds a sign followed by the word sign, no token crosses there: texts fall into words, and a worker keeps the
tokens of short words in a bounded table.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import column, small_batches

#: The sign that stands for a space.
SPACE = "▁"
#: Words of at most SHORT code points are kept in a worker's table of at most TABLE words; PAIRS bounds the table of checked neighbours.
SHORT, TABLE, PAIRS = 48, 200_000, 400_000
#: A text's words are taken in slices of about so many code points.
SLICE = 1 << 16


class PieceBpe:
    """A merge-type SentencePiece model without normalisation of letters."""

    def __init__(self, pieces: dict[str, tuple[int, float]], bytes_: list[int] | None, unknown: int, surface: str = " ⁇ ", control: Iterable[int] = (), prefix: bool = True) -> None:
        self.pieces, self.bytes, self.unknown, self.prefix = pieces, bytes_, unknown, prefix
        self.rank = {p: -score for p, (_, score) in pieces.items()}
        self.automaton = ahocorasick.Automaton()
        for p in pieces:
            self.automaton.add_word(p, len(p))
        self.automaton.make_automaton()
        self.raw = {i: p.replace(SPACE, " ").encode() for p, (i, _) in pieces.items()}
        self.raw |= {unknown: surface.encode()} | dict.fromkeys(control, b"")
        self.value = {i: b for b, i in enumerate(bytes_ or [])}
        if self.value:
            self.raw |= {i: bytes([b]) for i, b in self.value.items()}
        inner = {p[k : k + 2] for p in pieces for k in range(len(p) - 1)}
        lone = re.escape("".join(c for c in "\n\r\t" if not any(c in pair for pair in inner)))
        # letters by re's classes, less figures such as powers, which stand with the other signs
        odd = re.escape("".join(sorted({c for p in pieces for c in p if re.match(r"[^\W\d_]", c) and not c.isalpha()})))
        letter, other = rf"[^\W\d_{odd}]", rf"(?:[{odd}]|[^\w {SPACE}{lone}]|[\d_])" if odd else rf"(?:[^\w {SPACE}{lone}]|[\d_])"
        for cut in (rf"[ {SPACE}]*{letter}+|[ {SPACE}]*{other}+", rf"[ {SPACE}]*[^ {SPACE}{lone}]+"):
            whole = re.compile(rf"{cut}|[ {SPACE}]+")
            # a piece of one word's form crosses no border between words; so must every sign be a piece of its own, or none is foreign
            if all(whole.fullmatch(p) for p in pieces) and all(c in pieces for p in pieces for c in p):
                self.words = re.compile(rf"{cut}|[ {SPACE}]+" + (f"|[{lone}]" if lone else ""))
                break
        else:
            self.words = re.compile(r"(?s).+")
        self.apart = "(?s)" not in self.words.pattern
        self.made = {p: (b",%d" % i, self.raw[i]) for p, (i, _) in pieces.items()}
        self.short = max(map(len, pieces), default=1) < 256
        self.pairs: dict[tuple[str, str], bool] = {}
        self.shorter: dict[str, str] = {}
        self.table: dict[str, tuple[bytes, bytes]] = {}
        self.older: dict[str, tuple[bytes, bytes]] = {}

    @classmethod
    def load(cls, path: str) -> PieceBpe:
        """From a model file; its types of pieces and its normalisation must be those this class knows."""
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        spec, kinds = model.normalizer_spec, {k: [i for i, p in enumerate(model.pieces) if p.type == k] for k in range(1, 7)}
        if model.trainer_spec.model_type != 2 or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces or kinds[4] or kinds[5] or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only BPE models with plain normalisation and without user-defined or unused pieces are known")
        named = {model.pieces[i].piece: i for i in kinds[6]}
        fallback = [named[f"<0x{b:02X}>"] for b in range(256)] if model.trainer_spec.byte_fallback else None
        return cls({model.pieces[i].piece: (i, model.pieces[i].score) for i in kinds[1]}, fallback, kinds[2][0], model.trainer_spec.unk_surface, kinds[3], spec.add_dummy_prefix)

    def merge(self, text: str) -> list[str]:
        """Tokens of a short text by the merges themselves."""
        symbols, get, none = list(text), self.rank.get, float("inf")
        ranks = [get(a + b, none) for a, b in zip(symbols, symbols[1:])]
        while ranks and (best := min(ranks)) < none:
            i = ranks.index(best)
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = get(symbols[i - 1] + symbols[i], none)
            if i < len(ranks):
                ranks[i] = get(symbols[i] + symbols[i + 1], none)
        return symbols

    def fits(self, pair: tuple[str, str]) -> bool:
        """Whether two neighbours, or one token behind nothing, stay the tokens they are when merged anew."""
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        known = self.pairs[pair] = self._unchanged(*pair)
        return known

    def _unchanged(self, a: str, b: str) -> bool:
        """Whether the merges of a + b end in a and b: none crosses the border, and each side becomes one."""
        symbols, get, none = [*a, *b], self.rank.get, float("inf")
        border = len(a) - 1
        ranks = [get(x + y, none) for x, y in zip(symbols, symbols[1:])]
        while ranks and (best := min(ranks)) < none:
            i = ranks.index(best)
            if i == border:
                return False
            border -= i < border
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = get(symbols[i - 1] + symbols[i], none)
            if i < len(ranks):
                ranks[i] = get(symbols[i] + symbols[i + 1], none)
        return len(symbols) == (2 if a else 1)

    def _shorter(self, token: str) -> str:
        """The longest piece, or the single sign, that a token starts with and is not; empty for a single sign."""
        found = self.shorter.get(token)
        if found is None:
            found = next((token[:k] for k in range(len(token) - 1, 1, -1) if token[:k] in self.pieces), token[:1] if len(token) > 1 else "")
            self.shorter[token] = found
        return found

    def tokens(self, word: str) -> list[str]:
        """Tokens of a word, spaces as the word sign, by longest matches and backtracking."""
        size = len(word)
        longest = bytearray(b"\x01") * size if self.short else [1] * size
        for end, n in self.automaton.iter(word):
            # matches with one end come from the longest to the shortest, ends rise: the last at a place is the longest
            longest[end + 1 - n] = n
        pairs, fits, shorter, failed = self.pairs, self.fits, self.shorter, None
        out: list[str] = []
        at, last = 0, ""
        token = word[: longest[0]] if size else ""
        while at < size:
            end = at + len(token)
            pair = last, token
            known = pairs.get(pair)
            if (known or known is None and fits(pair)) and not (failed and failed[end >> 3] >> (end & 7) & 1):
                out.append(token)
                at, last = end, token
                token = word[at : at + longest[at]] if at < size else ""
                continue
            less = shorter.get(token)
            token = self._shorter(token) if less is None else less
            if not token:
                # nothing fits behind the token before: the rest cannot be reached from here
                failed = failed or bytearray(size // 8 + 1)
                failed[at >> 3] |= 1 << (at & 7)
                token = out.pop()
                at -= len(token)
                last = out[-1] if out else ""
        return out

    def ids(self, word: str) -> list[int]:
        out: list[int] = []
        for token in self.tokens(word):
            known = self.pieces.get(token)
            if known:
                out.append(known[0])
            elif self.bytes:
                out += [self.bytes[b] for b in token.encode("utf-8", "surrogatepass")]
            else:
                out.append(self.unknown)
        return out

    def _entry(self, word: str) -> tuple[bytes, bytes]:
        """The ids of a word in decimal, each with a comma before it, and the bytes they decode to."""
        if made := self.older.get(word):
            self._keep(word, made)
            return made
        plain = word.replace(" ", SPACE)
        try:
            parts = [self.made[t] for t in self.tokens(plain)]
            made = b"".join([p[0] for p in parts]), b"".join([p[1] for p in parts])
        except KeyError:  # a sign that is no piece
            ids = self.ids(plain)
            made = b"".join([b",%d" % i for i in ids]), self.joined(ids)
        if len(word) <= SHORT:
            self._keep(word, made)
        return made

    def _keep(self, word: str, made: tuple[bytes, bytes]) -> None:
        """Into the newer half of the table; what is not asked for again goes with the older one."""
        if len(self.table) >= TABLE:
            self.older = self.table.copy()
            self.table.clear()
        self.table[word] = made

    def split(self, text: str) -> Iterator[list[str]]:
        """The words of a text, slice by slice, the space that the model puts in front included; a slice ends where a word does."""
        if text and self.prefix:
            text = " " + text
        at = 0
        while at < len(text):
            cut = at + SLICE
            # behind a cut must stand a space, and none before it, unless words cannot be told apart
            while cut < len(text) and not (self.apart and text[cut] == " " and text[cut - 1] not in (" ", SPACE)):
                cut += 1
            yield self.words.findall(text, at, cut)
            at = cut

    def encode(self, text: str) -> list[int]:
        return [i for words in self.split(text) for word in words for i in self.ids(word.replace(" ", SPACE))]

    def joined(self, ids: Iterable[int]) -> bytes:
        """The bytes of ids, the first space included."""
        return b"".join(map(self.raw.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        """The text of any ids; bytes that are no UTF-8 give U+FFFD each."""
        out, run, first = [], bytearray(), self.prefix
        for i in ids:
            if i in self.value:
                run.append(self.value[i])
                continue
            out.append(repaired(bytes(run)))
            first = first and not run
            run.clear()
            text = self.raw[i].decode()
            if first and i != self.unknown and text.startswith(" "):
                text, first = text[1:], False
            first = first and not text
            out.append(text)
        return "".join(out) + repaired(bytes(run))

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids in decimal, comma-joined, and SHA-256 of the text decoded from them, slice by slice."""
        n, ids, decoded, get, made = 0, hashlib.sha256(), hashlib.sha256(), self.table.get, self._entry
        skip = 1
        for words in self.split(text):
            found = [get(w) or made(w) for w in words]
            own = b"".join([f[0] for f in found])
            n += own.count(b",")
            ids.update(own[skip:])
            back = b"".join([f[1] for f in found])
            decoded.update(back[1:] if skip and self.prefix and back.startswith(b" ") else back)
            skip = 0
        return n, ids.hexdigest(), decoded.hexdigest()


def repaired(raw: bytes) -> str:
    """UTF-8 text of bytes, each that belongs to no letter as U+FFFD."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(raw):
            for n in (1, 2, 3, 4):
                try:
                    out.append(raw[at : at + n].decode())
                    break
                except UnicodeDecodeError:
                    continue
            else:
                n = 1
                out.append("�")
            at += n
        return "".join(out)


@lru_cache(maxsize=2)
def model(path: str) -> PieceBpe:
    return PieceBpe.load(path)


def _digests(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    own = model(path)
    for batch in batches:
        rows = [own.digest(text.as_py() or "") for text in batch.column("text")]
        n, ids, decoded = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def _tokens(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    own = model(path)
    for batch in batches:
        rows = [own.encode(text.as_py() or "") for text in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.list_(pa.int32())), pa.array([own.decode(r) for r in rows], pa.string())], names=["doc_id", "ids", "decoded"])


def encode_pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, ids (array of int), decoded (text).  Null and empty texts have no ids; repeated rows give repeated rows."""
    base = docs.select(column(id_col).alias("doc_id"), column(text_col).cast("string").alias("text"))
    small_batches(docs.sparkSession)
    return base.mapInArrow(lambda it: _tokens(it, path), f"doc_id {docs.schema[id_col].dataType.simpleString()}, ids array<int>, decoded string")


def piece_digest(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids_sha256, decoded_sha256; narrow, with no shuffle.

    Null and empty texts have no ids and the digests of nothing; repeated rows give repeated rows, an empty table none; other
    columns, whatever they are called, are not read.  A worker holds a batch of texts, its tables of bounded size, and for one
    text a few bytes for each letter of its longest word.
    """
    base = docs.select(column(id_col).alias("doc_id"), column(text_col).cast("string").alias("text"))
    small_batches(docs.sparkSession)
    return base.mapInArrow(lambda it: _digests(it, path), f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
