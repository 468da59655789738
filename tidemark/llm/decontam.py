"""Benchmark decontamination: rare n-gram seeds join passages to items, then Smith-Waterman alignment.

One narrow pass over the corpus, whatever the benchmark's size, takes from each document the passages around n-grams that some
item has, by a table of bounded size.  How many passages hold an n-gram says which are rare: a seed is a rare trigram, or where the
trigram is common the four words there.  Seeds join the passages to their items, and each pair is aligned around its
seeds, so that copies with words changed, left out or put in are found.  What is not aligned falls by a bound on the score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, few, small_batches, spare, stash, text_of

MATCH, MISMATCH, GAP = 2, -1, -1
#: Words of a seed, and of one whose first words are common.
SEED, LONGER = 3, 4
#: So many different n-grams of items are looked up in a sorted table (16 bytes each); beyond, in a bitmap of FILTER_BITS.
MOST_GRAMS, FILTER_BITS, PART_BITS = 4_000_000, 1 << 28, 32768
#: ASCII capitals fold, other ASCII signs but letters and digits separate words.
_FOLD = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_FOLD).split()


def word_codes(text: str | None, seen: dict[bytes, int]) -> np.ndarray:
    """64-bit hashes of a text's words; seen is a table of bounded size."""
    if len(seen) > 100_000:
        seen.clear()
    out, digest = [], xxhash.xxh64_intdigest
    for word in words_of(text):
        code = seen.get(word)
        if code is None:
            code = digest(word)
            if len(word) < 64:
                seen[word] = code
        out.append(code)
    return np.array(out, np.uint64)


def gram_codes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the n-grams of so many words, in order."""
    if len(words) < size:
        return np.empty(0, np.int64)
    with np.errstate(over="ignore"):
        h = np.full(len(words) - size + 1, size, np.uint64)
        for k in range(size):
            h = (h ^ words[k : len(words) - size + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    return h.view(np.int64)


def slack(size):  # noqa: ANN001, ANN201
    """Words that an alignment may drift from its seeds' diagonal, by the item's size."""
    return np.maximum(8, size // 3)


class GramFilter:
    """Which n-grams items may have, and how far their items reach before and behind them."""

    def __init__(self, sizes: list[int], codes: np.ndarray | None, before: np.ndarray, after: np.ndarray, bitmap: np.ndarray | None = None) -> None:
        self.sizes, self.codes, self.before, self.after, self.bitmap = sizes, codes, before, after, bitmap

    def hits(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Places and codes of a document's n-grams that items have, in order of place, and the first and last word of their items' reach."""
        places, codes = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for size in self.sizes:
            code = gram_codes(words, size)
            places.append(np.arange(len(code)))
            codes.append(code)
        at, code = np.concatenate(places), np.concatenate(codes)
        if self.codes is None:
            cell = np.mod(code, FILTER_BITS)
            keep = np.flatnonzero(self.bitmap[cell >> 3] >> (cell & 7).astype(np.uint8) & 1)
            reach = np.zeros(len(keep), np.int64)
        elif len(self.codes):
            found = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            keep = np.flatnonzero(self.codes[found] == code)
            reach = found[keep]
        else:
            keep = reach = np.empty(0, np.int64)
        keep, reach = keep[order := np.argsort(at[keep], kind="stable")], reach[order]
        at = at[keep]
        return at, code[keep], np.maximum(at - self.before[reach], 0), np.minimum(at + self.after[reach], len(words))


def common_words(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, which no alignment's matches exceed; b's places are bits."""
    places: dict[int, int] = {}
    for k, x in enumerate(b.tolist()):
        places[x] = places.get(x, 0) | 1 << k
    full = (1 << len(b)) - 1
    free = full
    for x in a.tolist():
        if hit := free & places.get(x, 0):
            free = (free + hit | free - hit) & full
    return len(b) - free.bit_count()


def smith_waterman(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Best local alignment score of two number sequences, and the end of its part of b (the first of equals)."""
    j = np.arange(len(b) + 1)
    row = np.zeros(len(b) + 1, np.int64)
    top, end = 0, 0
    for x in a:
        take = np.maximum(row + GAP, 0)
        take[1:] = np.maximum(take[1:], row[:-1] + np.where(b == x, MATCH, MISMATCH))
        # gaps along b: the best of what stands to the left, less a gap for each step
        row = np.maximum.accumulate(take - GAP * j) + GAP * j
        k = int(row.argmax())
        if row[k] > top:
            top, end = int(row[k]), k
    return top, end


def best_alignment(words: np.ndarray, passage: np.ndarray, diagonals: np.ndarray, least: float) -> tuple[int, int, int] | None:
    """Score, first word and the word after the last of the best alignment of an item with a passage around its seeds' diagonals, if it reaches least."""
    diagonals, drift, best = np.sort(diagonals), int(slack(len(words))), None
    cuts = np.flatnonzero(np.diff(diagonals) > drift) + 1
    for part in np.split(diagonals, cuts):
        low, high = max(0, int(part[0]) - drift), min(len(passage), int(part[-1]) + len(words) + drift)
        window = passage[low:high]
        # no alignment has more matches than the window has words of the item, or than their longest common subsequence
        if np.isin(window, words).sum() < least * len(words) or common_words(words, window) < least * len(words):
            continue
        score, end = smith_waterman(words, window)
        if score >= least * MATCH * len(words) and (best is None or score > best[0]):
            _, back = smith_waterman(words[::-1], window[:end][::-1])
            best = score, low + end - back, low + end
    return best


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: dict[bytes, int] = {}
    for batch in batches:
        rows = [word_codes(text.as_py(), seen).view(np.int64) for text in batch.column("text")]
        grams = [[(size, a, int(code)) for size in ([SEED, LONGER] if len(r) >= SEED else [len(r)] if len(r) else []) for a, code in enumerate(gram_codes(r.view(np.uint64), size))] for r in rows]
        kind = pa.list_(pa.struct([("size", pa.int32()), ("at", pa.int32()), ("h", pa.int64())]))
        made = pa.array([[{"size": s, "at": a, "h": h} for s, a, h in g] for g in grams], kind)
        yield pa.RecordBatch.from_arrays([batch.column("item"), batch.column("item_id"), pa.array(rows, pa.list_(pa.int64())), made], names=["item", "item_id", "words", "grams"])


def gram_filter(grams: DataFrame, most_grams: int = MOST_GRAMS) -> GramFilter:
    """From (size, at, h, n) of all items; a table of at most most_grams rows, or a bitmap of fixed size, reaches the driver."""
    sizes = sorted(r[0] for r in grams.select("size").distinct().collect())
    drift = F.greatest(F.lit(8), F.floor(F.col("n") / 3))
    reach = [F.max(F.col("at") + drift).alias("before"), F.max(F.col("n") - F.col("at") + drift).alias("after")]
    table = stash(grams.groupBy("h").agg(*reach), "grams")
    if few(table, most_grams):
        got = table.toPandas().sort_values("h")
        return GramFilter(sizes, got.h.to_numpy(np.int64), got.before.to_numpy(np.int64), got.after.to_numpy(np.int64))
    cell = F.pmod("h", F.lit(FILTER_BITS))
    maps = table.groupBy(F.floor(cell / PART_BITS).alias("part")).agg(F.bitmap_construct_agg(cell % PART_BITS).alias("bits")).collect()
    bitmap = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in maps:
        bitmap[r.part * PART_BITS // 8 : (r.part + 1) * PART_BITS // 8] = np.frombuffer(r.bits, np.uint8)
    far = table.agg(F.max("before"), F.max("after")).first()
    return GramFilter(sizes, None, np.array([far[0]]), np.array([far[1]]), bitmap)


def _passages(batches: Iterator[pa.RecordBatch], own: GramFilter) -> Iterator[pa.RecordBatch]:
    seen: dict[bytes, int] = {}
    longs = pa.list_(pa.int64())
    for batch in batches:
        rows, starts, words, places, codes = [], [], [], [], []
        for k, text in enumerate(batch.column("text")):
            ids = word_codes(text.as_py(), seen)
            at, code, low, high = own.hits(ids)
            if not len(at):
                continue
            order = np.argsort(low, kind="stable")
            at, code, low, high = at[order], code[order], low[order], high[order]
            ends = np.maximum.accumulate(high)
            cuts = np.flatnonzero(low[1:] > ends[:-1]) + 1
            for part in np.split(np.arange(len(at)), cuts):
                start, end = int(low[part[0]]), int(ends[part[-1]])
                rows.append(k)
                starts.append(start)
                words.append(ids[start:end].view(np.int64))
                places.append(at[part] - start)
                codes.append(code[part])
        if rows:
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c).take(pa.array(rows)) for c in ("rid", "doc_id", "th", "n")], pa.array(starts, pa.int64()), pa.array(words, longs), pa.array(places, longs), pa.array(codes, longs)],
                names=["rid", "doc_id", "th", "n", "start", "words", "at", "h"],
            )


def _aligned(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, found = [], []
        for k in range(batch.num_rows):
            passage, item, diagonals = (batch.column(c)[k].values.to_numpy() for c in ("words", "item_words", "diagonals"))
            best = best_alignment(item, passage, diagonals, least)
            if best:
                rows.append(k)
                start = batch.column("start")[k].as_py()
                found.append((best[0] / (MATCH * len(item)), start + best[1], start + best[2]))
        if rows:
            score, first, last = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(pa.array(rows)) for c in ("rid", "doc_id", "th", "n", "item", "item_id")], pa.array(score), pa.array(first, pa.int64()), pa.array(last, pa.int64())], names=["rid", "doc_id", "th", "n", "item", "item_id", "score", "start_word", "end_word"])


def rare_seeds(grams: DataFrame, counts: DataFrame, factor: int, floor: int) -> DataFrame:
    """The seeds (item, at, h) among all n-grams (item, n, size, at, h) of items, by the number of passages (h, df) that hold each.

    A trigram is rare if no more than factor times as many passages hold it as hold the lower quartile of its item's trigrams that occur
    at all (floor passages always are few): measured against its own item, so one that many documents copy keeps its seeds.
    Where a trigram is common, the four words that it begins are the seed.  Items with fewer words are one seed, and so is an item of three.
    """
    known = stash(grams.join(counts, "h"), "known")
    limits = known.where(F.col("size") == SEED).groupBy("item").agg(F.greatest(F.lit(floor), factor * F.percentile_approx("df", 0.25)).alias("limit"))
    judged = known.join(limits, "item", "left").withColumn("common", (F.col("size") == SEED) & (F.col("df") > F.col("limit")) & (F.col("n") > SEED))
    common = judged.where("common").select("item", "at")
    longer = known.where(F.col("size") == LONGER).join(common, ["item", "at"], "left_semi")
    return judged.where(F.col("size") <= SEED).where("not coalesce(common, false)").select("item", "at", "h").unionByName(longer.select("item", "at", "h"))


def _links(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str, least: float, factor: int, floor: int, most_grams: int) -> DataFrame:
    """(rid, doc_id, th, n, item, item_id, score, start_word, end_word): alignments of passages that reach least."""
    spark = docs.sparkSession
    small_batches(spark)
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    base = benchmark.select(F.monotonically_increasing_id().alias("item"), column(item_col).alias("item_id"), text_of(item_text_col).alias("text"))
    items = stash(base.mapInArrow(_items, f"item long, item_id {item_kind}, words array<long>, grams array<struct<size:int,at:int,h:long>>"), "items")
    grams = stash(items.select("item", F.size("words").alias("n"), F.inline("grams")), "item_grams")
    own = spark.sparkContext.broadcast(gram_filter(grams, most_grams))
    text = column(text_col).cast("string")
    corpus = docs.select(F.monotonically_increasing_id().alias("rid"), column(id_col).alias("doc_id"), F.xxhash64(text_of(text_col)).alias("th"), F.coalesce(F.octet_length(text), F.lit(0)).alias("n"), text.alias("text"))
    schema = f"rid long, doc_id {kind}, th long, n int, start long, words array<long>, at array<long>, h array<long>"
    passages = stash(corpus.mapInArrow(lambda it: _passages(it, own.value), schema), "passages")
    counts = stash(passages.select(F.explode(F.array_distinct("h")).alias("h")).groupBy("h").agg(F.count("*").alias("df")), "counts")
    seeds = stash(rare_seeds(grams, counts, factor, floor).withColumnRenamed("at", "place"), "seeds")
    hits = passages.select("rid", "start", F.inline(F.arrays_zip("at", "h")))
    met = hits.join(F.broadcast(seeds) if few(seeds) else seeds, "h").groupBy("rid", "start", "item").agg(F.collect_set(F.col("at") - F.col("place")).alias("diagonals"))
    met = stash(met, "met")
    pairs = passages.select("rid", "doc_id", "th", "n", "start", "words").join(met, ["rid", "start"])
    texts = items.select("item", "item_id", F.col("words").alias("item_words"))
    # a passage and an item meet once, with all diagonals of their seeds, at most as many as the passage has words
    pairs = pairs.join(texts, "item").select("rid", "doc_id", "th", "n", "start", "words", "item", "item_id", "item_words", "diagonals")
    return pairs.mapInArrow(lambda it: _aligned(it, least), f"rid long, doc_id {kind}, th long, n int, item long, item_id {item_kind}, score double, start_word long, end_word long")


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least: float = 0.4, factor: int = 20, floor: int = 50, most_grams: int = MOST_GRAMS) -> DataFrame:
    """One row per document and item it copies: doc_id, item_id, score, start_word, end_word.

    score is the alignment's over the best the item can have, at least least.  Null and empty texts
    copy nothing; items of one or two words are found where all their words stand.  Repeated documents and items give
    repeated rows.  Either table empty gives no rows.  factor and floor say which seeds are rare (rare_seeds()).
    """
    found = _links(docs, benchmark, id_col, text_col, item_col, item_text_col, least, factor, floor, most_grams)
    best = F.max_by(F.struct("score", "start_word", "end_word"), F.struct("score", -F.col("start_word")))
    return found.groupBy("rid", "doc_id", "item", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.*")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least: float = 0.4, factor: int = 20, floor: int = 50, most_grams: int = MOST_GRAMS) -> DataFrame:
    """The rows of docs that copy no item, with the columns of docs, whatever these are called.

    Null and empty texts copy nothing and stay; repeated rows are judged alike; an empty benchmark keeps all rows.  The texts that go
    are known by hash and length; they are broadcast only when counted to be few.
    """
    found = stash(_links(docs, benchmark, id_col, text_col, item_col, item_text_col, least, factor, floor, most_grams).select("th", "n").distinct(), "leaks")
    th, n, lth, ln = spare(docs, "th", "n", "lth", "ln")
    gone = found.select(F.col("th").alias(lth), F.col("n").alias(ln))
    tagged = docs.withColumns({th: F.xxhash64(text_of(text_col)), n: F.coalesce(F.octet_length(column(text_col).cast("string")), F.lit(0))})
    left = tagged.join(F.broadcast(gone) if few(gone) else gone, (F.col(th) == F.col(lth)) & (F.col(n) == F.col(ln)), "left_anti")
    return left.select(*map(column, docs.columns))
