"""BPE as a streaming transducer with bounded lookahead, and its decoder.

A text is cut into pieces (words) by the vocabulary's own rules.  Inside a piece, a token is emitted
as soon as nothing that may still come can change it.  How far that reach goes follows from the merge list: a
change on the right travels left only along merges of rising rank, each taking as its right part
what the one before took or made as its left part; the longest such chain, in symbols, is the lookahead.
So a piece of any length needs one buffer of a few lookaheads.  Short pieces repeat, and a worker keeps
the tokens of those it met in a bounded table.  Ids leave in chunks, and the decoder is a state machine that takes
chunks; what is held beside a text does not grow with it, but for a stretch without white space, which is
normalised as a whole.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, small_batches

#: Pieces up to so many symbols are kept in a worker's table of at most TABLE pieces.
SHORT, TABLE = 48, 60_000
#: Texts are read in slices of about so many code points.
SLICE = 1 << 16


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 for itself, the rest from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class WordBpe:
    """A lower-casing BPE vocabulary with word ends, from the JSON file of a public tokenizer."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], split: str, special: dict[str, int], end: str = "</w>") -> None:
        self.ids, self.end, self.special = vocabulary, end, special
        self.pieces = regex.compile(split)
        self.plain_pieces = re.compile(split.replace(r"\p{L}", "a-zA-Z").replace(r"\p{N}", "0-9"), re.ASCII)
        self.specials = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.rank = {pair: i for i, pair in enumerate(merges)}
        self.letters = byte_letters()
        self.tokens = {i: t.encode() for t, i in (vocabulary | special).items()}
        self.packed = {t: np.array(i, "<u4").tobytes() for t, i in vocabulary.items()}
        self.value = {c: b for b, c in enumerate(self.letters)}
        self.names = {i: t for t, i in special.items()}
        self.lookahead = self._lookahead(merges)
        self.table: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    @classmethod
    def load(cls, path: str) -> WordBpe:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        return cls(model["vocab"], merges, split, {t["content"]: t["id"] for t in spec["added_tokens"]}, model["end_of_word_suffix"])

    def _width(self, token: str) -> int:
        return len(token.removesuffix(self.end))

    def _lookahead(self, merges: list[tuple[str, str]]) -> int:
        """Symbols that must follow a token before it is final: the longest chain of merges of rising rank."""
        reach: dict[str, int] = {}  # by right part, over the merges of higher rank
        longest = 0
        for left, right in reversed(merges):
            far = self._width(left) + max(reach.get(left, 0), reach.get(left + right, 0))
            reach[right] = max(reach.get(right, 0), far)
            longest = max(longest, far + self._width(right))
        return longest + max((self._width(a + b) for a, b in merges), default=1)

    def _merge(self, symbols: list[str]) -> list[str]:
        """Merge the pair of lowest rank, leftmost first, until none is left."""
        get, none = self.rank.get, len(self.rank)
        ranks = [get(p, none) for p in zip(symbols, symbols[1:])]
        while ranks and (best := min(ranks)) < none:
            i = ranks.index(best)
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = get((symbols[i - 1], symbols[i]), none)
            if i < len(ranks):
                ranks[i] = get((symbols[i], symbols[i + 1]), none)
        return symbols

    def piece_tokens(self, symbols: Iterable[str]) -> Iterator[str]:
        """Tokens of one piece from its symbols, the last with the word end; holds a few lookaheads of them."""
        buffer: list[str] = []
        most = 4 * self.lookahead
        for s in symbols:
            buffer.append(s)
            if len(buffer) >= most:
                done = 0
                for token in self._merge(buffer[:]):
                    width = self._width(token)
                    if done + width > len(buffer) - self.lookahead:
                        break
                    yield token
                    done += width
                buffer = buffer[done:]
        yield from self._merge(buffer)

    def _symbols(self, piece: str) -> Iterator[str]:
        raw, letters = piece.encode("utf-8", "surrogatepass"), self.letters
        for b in raw[:-1]:
            yield letters[b]
        yield letters[raw[-1]] + self.end

    def piece_ids(self, piece: str) -> bytes:
        """A piece's ids, little-endian unsigned 32-bit."""
        raw, letters = piece.encode("utf-8", "surrogatepass"), self.letters
        if len(raw) <= SHORT:
            symbols = [letters[b] for b in raw]
            symbols[-1] += self.end
            tokens = self._merge(symbols)
        else:
            tokens = self.piece_tokens(self._symbols(piece))
        return b"".join([self.packed[t] for t in tokens])

    def _streamed(self, pieces: Iterable[str]) -> Iterator[bytes]:
        """The ids of pieces one by one, of a very long piece in chunks."""
        get, met = self.table.get, self._met
        for piece in pieces:
            if len(piece) <= SLICE:
                yield get(piece) or met(piece)
            else:
                tokens = self.piece_tokens(self._symbols(piece))
                while chunk := [self.packed[t] for t in islice(tokens, SLICE)]:
                    yield b"".join(chunk)

    def _met(self, piece: str) -> bytes:
        """Ids of a piece that is not in the table: from the older half of the table, or made anew."""
        ids = self.older.get(piece) or self.piece_ids(piece)
        if len(piece) <= SHORT:
            if len(self.table) >= TABLE:
                self.older = self.table.copy()
                self.table.clear()
            self.table[piece] = ids
        return ids

    def _plain(self, text: str) -> Iterator[bytes]:
        """The ids of each slice of a text."""
        get, met = self.table.get, self._met
        for part in slices(text):
            # letters fold one by one, so capital sigma knows no word end
            part = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
            find = self.plain_pieces if part.isascii() else self.pieces
            if len(part) <= 2 * SLICE:
                yield b"".join([get(piece) or met(piece) for piece in find.findall(part)])
            else:
                ids = self._streamed(m.group() for m in find.finditer(part))
                while chunk := b"".join(islice(ids, SLICE)):
                    yield chunk

    def encode(self, text: str) -> Iterator[bytes]:
        """The ids of a text in order, slice by slice; the special tokens' strings are those tokens."""
        at = 0
        for m in self.specials.finditer(text) if self.specials else ():
            yield from self._plain(text[at : m.start()])
            yield np.array(self.special[m.group()], "<u4").tobytes()
            at = m.end()
        yield from self._plain(text[at:])

    def decoder(self, joined: bool) -> Decoder:
        return Decoder(self, joined)

    def decode_tokens(self, ids: Iterable[int]) -> bytes:
        """All tokens with one space between them."""
        return self.decoder(True).feed(list(ids))

    def decode_text(self, ids: Iterable[int]) -> Iterator[str]:
        """Text as it becomes complete."""
        machine = self.decoder(False)
        for i in ids:
            yield machine.feed([i]).decode("utf-8", "surrogatepass")


class Decoder:
    """Ids to UTF-8 text, chunk by chunk; the state is what a chunk leaves open.

    joined: the vocabulary file names no decoder, and a library then writes the tokens as they are, with one space
    between them; open is whether a token came before.  Otherwise the letters become bytes again and word ends
    spaces; open are the first bytes of a character whose other bytes have not come.
    """

    def __init__(self, bpe: WordBpe, joined: bool) -> None:
        self.bpe, self.joined, self.begun = bpe, joined, False
        self.machine = None if joined else codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: list[int]) -> bytes:
        """What these ids complete."""
        if self.joined:
            made = b" ".join(map(self.bpe.tokens.__getitem__, ids))
            made = b" " + made if self.begun and ids else made
            self.begun = self.begun or bool(ids)
            return made
        return "".join(map(self._one, ids)).encode()

    def _one(self, i: int) -> str:
        if i in self.bpe.names:
            left = self.machine.decode(b"", True)
            self.machine.reset()
            return left + self.bpe.names[i]
        token, end = self.bpe.tokens[i].decode(), self.bpe.end
        ended = token.endswith(end)
        return self.machine.decode(bytes(self.bpe.value[c] for c in token.removesuffix(end)), ended) + " " * ended


def slices(text: str) -> Iterator[str]:
    """Slices of a long text that end at white space, so that no piece and no composed letter is cut; a
    stretch without white space stays whole."""
    at = 0
    while len(text) - at > SLICE:
        cut = at + SLICE
        while cut < len(text) and not (text[cut] in " \n\t\r" and (cut + 1 == len(text) or text[cut + 1].isascii())):
            cut += 1
        yield text[at:cut]
        at = cut
    yield text[at:]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> WordBpe:
    return WordBpe.load(path)


def digest_text(bpe: WordBpe, text: str) -> tuple[int, str, str]:
    """Number of ids, and the SHA-256 of the ids and of the text decoded from them, fed chunk by chunk."""
    n, ids, decoded, machine = 0, hashlib.sha256(), hashlib.sha256(), bpe.decoder(True)
    for chunk in bpe.encode(text):
        n += len(chunk) // 4
        ids.update(chunk)
        decoded.update(machine.feed(np.frombuffer(chunk, "<u4").tolist()))
    return n, ids.hexdigest(), decoded.hexdigest()


def _coded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    bpe = vocabulary(path)
    for batch in batches:
        counts, digests, decoded = [], [], []
        for text in batch.column("text"):
            n, own, back = digest_text(bpe, text.as_py() or "")
            counts.append(n)
            digests.append(own)
            decoded.append(back)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def _tokens(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    bpe = vocabulary(path)
    for batch in batches:
        rows = [np.frombuffer(b"".join(bpe.encode(t.as_py() or "")), "<u4").astype(np.int32) for t in batch.column("text")]
        texts = ["".join(bpe.decode_text(r.tolist())) for r in rows]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.list_(pa.int32())), pa.array(texts, pa.string())], names=["doc_id", "ids", "decoded"])


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, ids (array of int), decoded (text).  Null and empty texts have no ids."""
    small_batches(docs.sparkSession)
    base = docs.select(column(id_col).alias("doc_id"), column(text_col).cast("string").alias("text"))
    return base.mapInArrow(lambda it: _tokens(it, path), f"doc_id {docs.schema[id_col].dataType.simpleString()}, ids array<int>, decoded string")


def token_digest(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids_sha256, decoded_sha256; narrow, with no shuffle.

    Null and empty texts have no ids and the digests of nothing; repeated rows give repeated rows.
    """
    small_batches(docs.sparkSession)
    base = docs.select(column(id_col).alias("doc_id"), column(text_col).cast("string").alias("text"))
    return base.mapInArrow(lambda it: _coded(it, path), f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
