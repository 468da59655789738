"""Near-duplicate classes by b-bit MinHash.

Every document gets 128 minima over its 5-word shingles.  Bands of minima make candidates, as long as the
threshold allows: 25 of 5 at 0.85, 32 of 4 at 0.8.  Of all minima the low 4 bits are kept, packed into 8 longs, and
a pair's similarity is estimated from the bits that agree, corrected for agreement by chance.  Pairs whose estimate can reach the threshold
are confirmed on the full shingle sets.

Work stays linear in a group of copies.  Equal shingle sets collapse first.  Each band bucket is then
linked by a star to its leader.  What is left of a bucket, the members outside their leader's component, meets the
other members by rare shingles and not by the bucket: two sets that link share one of the first few shingles
of either, rarest first, as many as the threshold lets them differ in.  So members of a bucket that share
only what everyone has never meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import column, few, keep_rows, small_batches, stash, text_of
from .graph import components

MINIMA, BITS = 128, 4
LONGS = MINIMA * BITS // 64
#: In buckets from this size on the shingles that no other member has are counted.
LARGE = 32
_LANES = int("1" * (64 // BITS), 16)


def _family() -> tuple[np.ndarray, np.ndarray]:
    seeds = np.random.default_rng(2024)
    return seeds.integers(1, 2**63, MINIMA, dtype=np.uint64) | np.uint64(1), seeds.integers(0, 2**63, MINIMA, dtype=np.uint64)


def band_rows(percent: int, miss: float = 1e-6) -> int:
    """Minima per band: as many as let a pair at the threshold miss all bands with probability `miss` at most."""
    return max([1, *(r for r in range(1, 17) if (1 - (percent / 100) ** r) ** (MINIMA // r) <= miss)])


def shingle_hashes(text: str | None, size: int = 5, seen: dict[bytes, int] | None = None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles: A-Z lower-cased, words split at ASCII white
    space, fewer words than size as one shingle, none without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    seen = {} if seen is None else seen
    if len(seen) > 100_000:
        seen.clear()
    digest = xxhash.xxh64_intdigest
    ids = []
    for word in words:
        h = seen.get(word)
        if h is None:
            h = digest(word)
            if len(word) < 64:
                seen[word] = h
        ids.append(h)
    codes, span = np.array(ids, np.uint64), min(size, len(words))
    with np.errstate(over="ignore"):
        h = np.full(len(codes) - span + 1, span, np.uint64)
        for k in range(span):
            h = (h ^ codes[k : len(codes) - span + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    return np.unique(h)


def signature(shingles: np.ndarray, family: tuple[np.ndarray, np.ndarray], rows: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Band keys and packed low bits of a non-empty set's minima."""
    mul, add = family
    least = np.full(MINIMA, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(shingles), 512):
            h = mul[:, None] * shingles[None, at : at + 512]
            h += add[:, None]
            h ^= h >> np.uint64(32)
            np.minimum(least, h.min(axis=1), out=least)
        # a minimum's own low bits are skewed towards small values in the high bits only; mix before cutting
        mixed = least * np.uint64(0xD6E8FEB86659FD93)
        low = (mixed >> np.uint64(40)) & np.uint64((1 << BITS) - 1)
        lanes = low.reshape(LONGS, -1) << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS))
        bands = MINIMA // rows
        band = np.arange(1, bands + 1, dtype=np.uint64)
        for k in range(rows):
            band = (band ^ least[: bands * rows].reshape(bands, rows)[:, k]) * np.uint64(0x9E3779B97F4A7C15)
            band ^= band >> np.uint64(31)
    return band.view(np.int64), np.bitwise_or.reduce(lanes, axis=1).view(np.int64)


def _sign(batches: Iterator[pa.RecordBatch], size: int, band: int) -> Iterator[pa.RecordBatch]:
    family, seen = _family(), {}
    for batch in batches:
        counts, prints, bands, packs = [], [], [], []
        for text in batch.column("text"):
            h = shingle_hashes(text.as_py(), size, seen)
            counts.append(len(h))
            prints.append(xxhash.xxh128_digest(h.tobytes()) if len(h) else None)
            keys, pack = signature(h, family, band) if len(h) else (None, None)
            bands.append(keys)
            packs.append(pack)
        longs = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column("rid"), batch.column("doc_id"), batch.column("th"), pa.array(counts, pa.int64()), pa.array(prints, pa.binary()), pa.array(bands, longs), pa.array(packs, longs)],
            names=["rid", "doc_id", "th", "n", "print", "bands", "pack"],
        )


def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    seen: dict[bytes, int] = {}
    for batch in batches:
        rows = [shingle_hashes(text.as_py(), size, seen).view(np.int64) for text in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(rows, pa.list_(pa.int64()))], names=["node", "shingles"])


def _may_link(x: str, y: str, percent: int) -> Column:
    """Whether a pair can reach the threshold, by its sizes and, where both were counted in the crowd, by
    the shingles that no other member of the crowd has."""
    c = lambda side, name: F.col(f"{side}.{name}")
    both = c(x, "own").isNotNull() & c(y, "own").isNotNull()
    most = F.least(*[c(s, "n") - F.when(both, c(s, "own")).otherwise(0) for s in (x, y)])
    return 100 * most >= percent * (c(x, "n") + c(y, "n") - most)


def estimate(x: Column, y: Column) -> Column:
    """Similarity of two packed signatures: the share of agreeing lanes, less agreement by chance."""
    apart = F.lit(0)
    for i in range(LONGS):
        bits = x[i].bitwiseXOR(y[i])
        folded = bits
        for shift in range(1, BITS):
            folded = folded.bitwiseOR(F.shiftrightunsigned(bits, shift))
        apart = apart + F.bit_count(folded.bitwiseAND(F.lit(_LANES)))
    chance = 1 / 2**BITS
    return ((1 - apart / MINIMA) - chance) / (1 - chance)


def _rare_shingles(full: DataFrame, ring: DataFrame, percent: int) -> DataFrame:
    """For each node of the ring (node, label, open) the shingles of its prefix that others of the ring have too, with
    their place: its shingles in order of how many nodes have them, up to the n - ceil(percent / 100 * n) + 1st.  Two sets
    that reach the threshold share a shingle of both prefixes."""
    cells = full.join(ring, "node").select("node", "label", "open", F.size("shingles").alias("n"), F.explode("shingles").alias("h"))
    common = stash(cells.groupBy("h").agg(F.count("*").alias("holders")).where("holders > 1"), "holders")
    w = Window.partitionBy("node")
    # shingles that no other node has come first and only take places
    place = F.col("n") - F.count("*").over(w) + F.row_number().over(w.orderBy("holders", "h"))
    return cells.join(common, "h").withColumn("place", place).where(F.col("place") <= F.col("n") - F.floor((percent * F.col("n") + 99) / 100) + 1).select("node", "label", "open", "n", "h", "place")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, shingle: int = 5, slack_sigmas: float = 5.0) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept, n_links, th, chosen.

    Documents link when 100 * |intersection| >= percent * |union| of their shingle sets; component_id is
    the least doc_id reachable.  Null, empty and blank texts link with nothing.  kept says whether doc_id = component_id, for each of
    repeated rows and for blank ones too; chosen is true for one row of a component (in one of null ids only, kept is chosen) and for blank rows.  n_links counts confirmed links of the
    document's set to other sets that the search had to read.  A link at the threshold is missed by all
    bands with probability 1e-6 at most and by the estimate with that of slack_sigmas.  An empty
    table gives no rows.
    """
    small_batches(docs.sparkSession)
    ids = docs.schema[id_col].dataType
    source = docs.select(F.monotonically_increasing_id().alias("rid"), column(id_col).alias("doc_id"), F.xxhash64(text_of(text_col)).alias("th"), column(text_col).cast("string").alias("text"))
    schema = f"rid long, doc_id {ids.simpleString()}, th long, n long, print binary, bands array<long>, pack array<long>"
    signed = stash(source.mapInArrow(lambda it: _sign(it, shingle, band_rows(percent)), schema), "signed")

    # one node for each distinct set: the first of its rows
    classes = stash(signed.where("n > 0").groupBy("print").agg(F.min("rid").alias("node"), F.min("doc_id").alias("least")), "classes")
    nodes = stash(signed.join(classes.select(F.col("node").alias("rid")), "rid", "left_semi").select(F.col("rid").alias("node"), "doc_id", "th", "n", "bands", "pack"), "nodes")
    banded = nodes.select("node", F.explode("bands").alias("band"))
    # aggregates are written apart from the joins that read them, so that a large bucket is split over tasks there
    sizes = stash(banded.groupBy("band").agg(F.count("*").alias("count")).where("count > 1"), "sizes")
    met = stash(banded.join(sizes, "band"), "met")

    # the candidates' full sets, made anew from their texts
    keys = nodes.join(met.select("node").distinct(), "node", "left_semi").select("node", F.col("doc_id").alias("k"), F.col("th").alias("t"))
    texts = docs.select(column(id_col).alias("doc_id"), column(text_col).cast("string").alias("text")).withColumn("th", F.xxhash64(F.coalesce("text", F.lit(""))))
    found = texts.join(F.broadcast(keys) if few(keys) else keys, (F.col("th") == F.col("t")) & F.col("doc_id").eqNullSafe(F.col("k")))
    full = found.select("node", "text").mapInArrow(lambda it: _sets(it, shingle), "node long, shingles array<long>")
    full = stash(full.dropDuplicates(["node"]), "sets")  # repeated rows gave theirs twice

    crowd = met.where(F.col("count") >= LARGE).select("node").distinct()
    cells = full.join(crowd, "node", "left_semi").select("node", F.explode("shingles").alias("h"))
    lone = cells.groupBy("h").agg(F.min("node").alias("node"), F.max("node").alias("other")).where("node = other").select("node", "h")
    own = crowd.join(lone.groupBy("node").agg(F.count("*").alias("n_lone")), "node", "left").select("node", F.coalesce("n_lone", F.lit(0)).alias("own"))
    traits = stash(nodes.join(own, "node", "left").select("node", "n", "own", "pack"), "traits")
    # the leader has the smallest share of shingles of its own, so it stands in the middle of its bucket
    order = F.struct(F.coalesce("own", F.lit(0)) / F.col("n"), F.col("node"))
    member = stash(met.join(traits.select("node", "n", "own"), "node"), "member")
    leaders = stash(member.groupBy("band").agg(F.min(order).alias("lead"), F.min("n").alias("low")).select("band", F.col("lead.node").alias("leader"), "low"), "leaders")
    led = stash(member.join(leaders, "band"), "led")
    p = 1 - (1 - percent / 100) * (1 - 1 / 2**BITS)
    floor = percent / 100 - slack_sigmas * (p * (1 - p) / MINIMA) ** 0.5 / (1 - 1 / 2**BITS)

    def likely() -> Column:
        return _may_link("x", "y", percent) & (estimate(F.col("x.pack"), F.col("y.pack")) >= floor)

    def promising(pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) that sizes, unshared shingles and packed signatures let link."""
        x = pairs.join(traits.alias("x"), F.col("a") == F.col("x.node"))
        return x.join(traits.alias("y"), F.col("b") == F.col("y.node")).where(likely()).select("a", "b")

    pairs = promising(led.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct())

    def confirmed(asked: DataFrame) -> DataFrame:
        asked = asked.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        joined = asked.join(full.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a").join(full.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
        common = joined.select("a", "b", F.size(F.array_intersect("sa", "sb")).alias("i"), (F.size("sa") + F.size("sb")).alias("t"))
        return stash(common.where(F.lit(100) * F.col("i") >= percent * (F.col("t") - F.col("i"))).select("a", "b"), "links")

    links = confirmed(pairs)
    first = stash(components(links), "first")
    marked = stash(led.join(first, "node", "left").withColumn("label", F.coalesce("label", "node")), "marked")
    heads = first.select(F.col("node").alias("leader"), F.col("label").alias("head"))
    marked = marked.join(heads, "leader", "left").withColumn("head", F.coalesce("head", "leader"))
    # a bucket's open members: not in its leader's component, and not ruled out by the bucket's smallest set
    rest = F.col("n") - F.when(F.col("count") >= LARGE, F.col("own")).otherwise(0)
    stray = marked.where(F.col("label") != F.col("head")).where(100 * rest >= percent * (F.col("n") + F.greatest("low", rest) - rest))
    stray = stash(stray.where("count > 2").select("band", "node", "label"), "stray")
    ring = marked.join(stray.select("band").distinct(), "band", "left_semi").select("node", "label").distinct()
    ring = stash(ring.join(stray.select("node").distinct().withColumn("open", F.lit(True)), "node", "left").select("node", "label", F.coalesce("open", F.lit(False)).alias("open")), "ring")
    heads = stash(_rare_shingles(full, ring, percent), "prefixes")
    x, y = heads.where("open").alias("x"), heads.alias("y")
    # from a shared shingle on no more can be shared than what stands behind it in both
    most = 1 + F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place"))
    enough = 100 * most >= percent * (F.col("x.n") + F.col("y.n") - most)
    once = ~F.col("y.open") | (F.col("x.node") < F.col("y.node"))
    cross = x.join(y, (F.col("x.h") == F.col("y.h")) & (F.col("x.label") != F.col("y.label")) & once & enough)
    more = confirmed(promising(cross.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()))
    links = links.unionByName(more)
    labels = stash(components(links), "labels")
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))

    named = classes.join(labels, "node", "left").join(degree, "node", "left").withColumn("label", F.coalesce("label", "node"))
    named = stash(named.select("print", "least", "label", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")), "named")
    heads = stash(named.groupBy("label").agg(F.min("least").alias("component_id")), "heads")
    by_print = stash(named.join(heads, "label"), "by_print")
    placed = signed.where("n > 0").select("rid", "doc_id", "th", "n", "print").join(by_print, "print")
    placed = stash(placed.select("rid", "doc_id", "th", "n", "label", "component_id", "n_links"), "placed")
    keepers = placed.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("rid"))).alias("best")).select(F.col("best.rid").alias("best"))
    chosen = F.col("best").isNotNull()
    own = F.when(F.col("component_id").isNull(), chosen).otherwise(F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
    kept = placed.join(keepers, F.col("rid") == F.col("best"), "left").select("doc_id", F.col("n").alias("n_shingles"), "component_id", own.alias("kept"), "n_links", "th", chosen.alias("chosen"))
    blank = signed.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"), F.lit(0).cast("long").alias("n_links"), "th", F.lit(True).alias("chosen"))
    return kept.unionByName(blank)


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """One document of each near-duplicate component, with the columns of docs; repeated rows stay once, blank ones too."""
    return keep_rows(docs, near_groups(docs, id_col, text_col, percent).withColumn("kept", F.col("chosen")), id_col, text_col)
