"""Language identification by interpolated Kneser-Ney character models.

Each language has one model of letters in words, up to ORDER letters with the word's edge as a letter.
Counts of all languages stand side by side in arrays sorted by the n-gram's hash.  A text goes to the
language of the lowest cross-entropy per letter; it is rejected when that entropy lies beyond what calibration
texts of the language reached.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, numbered, small_batches, within

ORDER = 4
_STEP = np.uint64(0x100000001B3)
#: Letters scored at once.
CHUNK = 1 << 18


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def codes(text: str, letters: np.ndarray) -> np.ndarray:
    """Code points of a lower-cased text's letters; every stretch of anything else is one 0, also at both ends."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    c = np.where(letters[c], c, 0)
    c = np.concatenate(([0], c, [0])).astype(np.uint64)
    stay = np.ones(len(c), bool)
    stay[1:] = (c[1:] != 0) | (c[:-1] != 0)
    return c[stay]


def hashes(c: np.ndarray, order: int) -> np.ndarray:
    """Hash of the order code points that end at each place from order - 1 on."""
    h = np.zeros(max(len(c) - order + 1, 0), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(order):
            h = (h ^ (c[k : len(c) - order + 1 + k] + np.uint64(1))) * _STEP
            h ^= h >> np.uint64(27)
    return h


class KneserNey:
    """Models of all languages.  For each order a sorted hash array with a row of counts per n-gram; for each
    context its total and number of different followers."""

    def __init__(self, langs: list[str], grams: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        """grams: for each order 1.. the n-grams' codes (rows), and counts (n-grams x langs)."""
        self.langs, self.tables, self.contexts, self.discount = langs, [], [], []
        for order in range(1, ORDER + 1):
            letters, counts = grams[order - 1]
            if order < ORDER:  # how many different letters precede it, but for n-grams at a word's start
                longer, more = grams[order]
                keys = _rows(longer[:, 1:])
                at = np.searchsorted(np.sort(_rows(letters)), keys)
                place = np.argsort(_rows(letters))[np.minimum(at, len(letters) - 1)]
                kinds = np.zeros(counts.shape)
                np.add.at(kinds, place, (more > 0).astype(float))
                counts = np.where(kinds > 0, kinds, (counts > 0).astype(float))
            n1, n2 = (counts == 1).sum(0), (counts == 2).sum(0)
            self.discount.append(np.clip(n1 / np.maximum(n1 + 2 * n2, 1), 0.1, 0.9))
            h = _rows(letters)
            by = np.argsort(h)
            self.tables.append((h[by], counts[by]))
            c, inverse = np.unique(_rows(letters[:, :-1]), return_inverse=True)
            total, kinds = np.zeros((len(c), len(langs))), np.zeros((len(c), len(langs)))
            np.add.at(total, inverse, counts)
            np.add.at(kinds, inverse, (counts > 0).astype(float))
            self.contexts.append((c, total, kinds))
        self.floor = np.full(len(langs), 1 / (len(self.tables[0][0]) + 1))
        self.limits: tuple[np.ndarray, np.ndarray] = (np.full(len(langs), np.inf), np.ones(len(langs)))

    def bits(self, c: np.ndarray) -> np.ndarray:
        """Minus log2 probability per language of the last letter of each row of ORDER codes."""
        p = np.repeat(self.floor[None], len(c), 0)
        for order in range(1, ORDER + 1):
            (keys, counts), (contexts, total, kinds) = self.tables[order - 1], self.contexts[order - 1]
            own, above = _rows(c[:, ORDER - order :]), _rows(c[:, ORDER - order : -1])
            got = _found(keys, counts, own)
            t, k = _found(contexts, total, above), _found(contexts, kinds, above)
            d = self.discount[order - 1]
            safe = np.maximum(t, 1e-9)
            p = np.where(t > 0, np.maximum(got - d, 0) / safe + d * k / safe * p, p)
        return -np.log2(p)

    def entropy(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Letters scored and bits per letter and language of each text of codes."""
        sizes = np.zeros(len(texts))
        total = np.zeros((len(texts), len(self.langs)))
        for owners, grams, rows in _chunks(texts):
            unique, first, inverse = np.unique(grams, return_index=True, return_inverse=True)
            score = self.bits(rows(first))
            starts = np.flatnonzero(np.concatenate(([True], owners[1:] != owners[:-1])))
            for lang in range(len(self.langs)):
                total[owners[starts], lang] += np.add.reduceat(score[inverse, lang], starts)
            sizes[owners[starts]] += np.diff(np.append(starts, len(owners)))
        return sizes, total / np.maximum(sizes, 1)[:, None]

    def decide(self, texts: list[np.ndarray]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score, bits per letter, and whether the text is rejected; no letters: und, 0, 0, True."""
        sizes, h = self.entropy(texts)
        best = h.argmin(1)
        least = h[np.arange(len(h)), best]
        weight = np.minimum(sizes, 40) * math.log(2)
        score = 1 / np.exp((least[:, None] - h) * weight[:, None]).sum(1)
        top, spread = self.limits
        empty = sizes == 0
        rejected = empty | (least > top[best] + np.maximum(1.5, 6 * spread[best]) * (1 + 10 / np.sqrt(np.maximum(sizes, 1))))
        names = ["und" if e else self.langs[b] for b, e in zip(best, empty, strict=True)]
        return names, np.where(empty, 0.0, score), np.where(empty, 0.0, least), rejected

    def calibrate(self, bits: np.ndarray, langs: list[str]) -> None:
        """Set each language's limit from the bits per letter of labelled texts of 20 letters or more under their own
        language: the highest of the usual ones, and their spread."""
        top, spread = [], []
        for lang in self.langs:
            own = bits[[x == lang for x in langs]]
            top.append(np.quantile(own, 0.99) if len(own) else np.inf)
            spread.append(max(float(own.std()), 0.25) if len(own) else 1.0)
        self.limits = (np.array(top), np.array(spread))


def _rows(letters: np.ndarray) -> np.ndarray:
    """Hash of each row of codes."""
    h = np.zeros(len(letters), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(letters.shape[1]):
            h = (h ^ (letters[:, k] + np.uint64(1))) * _STEP
            h ^= h >> np.uint64(27)
    return h


def _found(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Rows of values at wanted in the sorted keys, 0 where absent."""
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where((keys[at] == wanted)[:, None], values[at], 0.0)


def _chunks(texts: list[np.ndarray]) -> Iterator[tuple]:
    """Texts joined up to CHUNK letters, long ones cut with overlap: owner and hash of each scored n-gram."""
    part: list[tuple[int, np.ndarray]] = []
    held = 0

    def done() -> tuple:
        c = np.concatenate([x for _, x in part])
        owners = np.concatenate([np.full(len(x), i) for i, x in part])
        ends = np.arange(ORDER - 1, len(c))
        # a letter or a word's end is scored; a 0 after a 0 is padding, and a window must not reach into the text before
        real = (owners[ends] == owners[ends - ORDER + 1]) & ((c[ends] != 0) | (c[ends - 1] != 0))
        ends = ends[real]
        return owners[ends], hashes(c, ORDER)[real], lambda first: np.stack([c[ends[first] - ORDER + 1 + k] for k in range(ORDER)], 1)

    for i, c in enumerate(texts):
        for at in range(0, max(len(c) - 1, 0), CHUNK):
            piece = c[at - ORDER + 1 : at + CHUNK] if at else np.concatenate((np.zeros(ORDER - 1, np.uint64), c[:CHUNK]))
            part.append((i, piece))
            held += len(piece)
            if held >= CHUNK:
                yield done()
                part, held = [], 0
    if part:
        yield done()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch and language the n-grams of all orders with their counts."""
    letters = _letters()
    for batch in batches:
        by: dict[str, list[np.ndarray]] = {}
        for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
            by.setdefault(lang, []).append(np.concatenate((np.zeros(ORDER - 1, np.uint64), codes(text, letters))))
        for lang, texts in by.items():
            for order in range(1, ORDER + 1):
                c = np.concatenate(texts)
                h = hashes(c, order)
                ends = np.arange(order - 1, len(c))
                real = (c[ends] != 0) | (c[np.maximum(ends - 1, 0)] != 0)
                ends, h = ends[real], h[real]
                _, first, n = np.unique(h, return_index=True, return_counts=True)
                rows = np.stack([c[ends[first] - order + 1 + k] for k in range(order)], 1)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array(rows.astype(np.int32).tolist(), pa.list_(pa.int32())), pa.array(n)], names=["lang", "gram", "n"])


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_lang: int = 1500, max_chars: int = 60_000_000) -> KneserNey | None:
    """Fit the models on about docs_per_lang labelled texts of each language (a hash of the id draws them; fewer
    where there are fewer), and of these on those that fit into max_chars code points: four fifths for counts, one fifth
    to calibrate.  Spark counts and scores; what reaches the driver are the n-grams of the one part and an entropy for
    each text of the other, so both parameters bound it.  None without any labelled text."""
    small_batches(docs.sparkSession)
    base = docs.select(column(id_col).alias("id"), column(text_col).cast("string").alias("text"), column(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    sizes = {r.lang: r["count"] for r in base.groupBy("lang").count().collect()}
    if not sizes:
        return None
    langs = sorted(sizes)
    draw = F.pmod(F.xxhash64("id", F.lit("langid")), F.lit(1_000_000))
    level = F.coalesce(*[F.when(F.col("lang") == lang, F.lit(int(1_000_000 * min(1.0, docs_per_lang / sizes[lang])) + 1)) for lang in langs])
    sample = within(base.where(draw < level), "id", "text", max_chars)
    fit, held = sample.where(F.pmod(F.xxhash64("id"), F.lit(5)) != 0), sample.where(F.pmod(F.xxhash64("id"), F.lit(5)) == 0)
    grams = fit.select("text", "lang").mapInArrow(_counted, "lang string, gram array<int>, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    if not grams.num_rows:
        grams = sample.select("text", "lang").mapInArrow(_counted, "lang string, gram array<int>, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    place = {lang: i for i, lang in enumerate(langs)}
    tables: list[dict[tuple[int, ...], np.ndarray]] = [{} for _ in range(ORDER)]
    for lang, gram, n in zip(*(grams.column(c).to_pylist() for c in ("lang", "gram", "n")), strict=True):
        tables[len(gram) - 1].setdefault(tuple(gram), np.zeros(len(langs)))[place[lang]] = n
    model = KneserNey(langs, [(np.array(list(t), np.uint64).reshape(len(t), -1), np.array(list(t.values()))) for t in tables])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, letters = shared.value, _letters()
        for batch in batches:
            given = batch.column("lang").to_pylist()
            sizes, h = own.entropy([codes(t, letters) for t in batch.column("text").to_pylist()])
            long = np.flatnonzero(sizes >= 20).tolist()
            yield pa.RecordBatch.from_arrays([pa.array([given[k] for k in long], pa.string()), pa.array([h[k, place[given[k]]] for k in long], pa.float64())], names=["lang", "bits"])

    rows = held.select("text", "lang").mapInArrow(scored, "lang string, bits double").collect()
    model.calibrate(np.array([r.bits for r in rows]), [r.lang for r in rows])
    shared.unpersist()
    return model


def _judged(batches: Iterator[pa.RecordBatch], model: KneserNey | None, text_col: str = "text") -> Iterator[tuple]:
    letters = _letters()
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            part = batch.slice(at, 200)
            texts = [codes(t or "", letters) for t in part.column(text_col).to_pylist()]
            if model is None:
                yield part, (["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts)), np.full(len(texts), True))
            else:
                yield part, model.decide(texts)


def identify(docs: DataFrame, model: KneserNey | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, lang_pred, score (0 to 1), bits (per letter), rejected.

    Null text, empty text and text without letters give und, 0, 0 and rejected; so does a missing model.  Ties
    go to the first language by name.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, (langs, score, bits, rejected) in _judged(batches, shared.value):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(langs, pa.string()), pa.array(score), pa.array(bits), pa.array(rejected)], names=["doc_id", "lang_pred", "score", "bits", "rejected"])

    base = docs.select(column(id_col).alias("doc_id"), column(text_col).cast("string").alias("text"))
    return base.mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, lang_pred string, score double, bits double, rejected boolean")


def keep_identified(docs: DataFrame, model: KneserNey | None, text_col: str = "text") -> DataFrame:
    """The rows that the models do not reject, with the columns of docs, whatever these are called, in one narrow pass.

    Null texts, empty ones and those without letters go, and without models all rows; repeated rows are judged alike.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, (*_, rejected) in _judged(batches, shared.value, "judged"):
            kept = part.filter(pa.array(~rejected))
            if kept.num_rows:
                yield pa.RecordBatch.from_arrays(kept.columns[:-1], names=names)

    return numbered(docs, text_col).mapInArrow(run, docs.schema)
