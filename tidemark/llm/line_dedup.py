"""Removal of lines that stand on many sites, by sketches of the sites of each line hash.

A cheap pass keeps the line hashes that stand on two sites at least.  For these, HyperLogLog
sketches of the sites merge by aggregation; a line whose estimate lies near the threshold gets
an exact distinct count.  Lines over the threshold leave every document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, few, stash, text_of

#: Up to so many line hashes go to the tasks as one table of 8 bytes each; beyond, the documents that hold them are joined.
TABLE_LINES = 200_000


def spread_lines(lines: DataFrame, min_sites: int, lg_k: int = 12, sigmas: float = 3.0) -> DataFrame:
    """From (h, site): the hashes h on min_sites distinct sites or more.

    Sites meet as 64-bit hashes.  The relative error of a sketch is 1.04 / sqrt(2 ** lg_k); estimates
    within sigmas of it (one site at least) around the threshold are counted exactly.
    """

    def only(keys: DataFrame) -> DataFrame:
        # a few keys are broadcast, so that sites combine before they move; else the join's rows are written apart from
        # the aggregation, so that a common line's rows are split over tasks in both
        return lines.join(F.broadcast(keys), "h", "left_semi") if few(keys) else stash(lines.join(keys, "h", "left_semi"), "lines_of")

    spread = stash(lines.groupBy("h").agg(F.min("site").alias("a"), F.max("site").alias("b")).where("a <> b").select("h"), "two_sites")
    sketches = stash(only(spread).groupBy("h").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", lg_k)).alias("about")), "sketches")
    margin = max(1.0, sigmas * 1.04 / 2 ** (lg_k / 2) * min_sites)
    sure = sketches.where(F.col("about") > min_sites + margin).select("h")
    near = stash(sketches.where(F.abs(F.col("about") - min_sites) <= margin).select("h"), "near_sites")
    pairs = only(near).groupBy("h", "site").agg(F.count("*").alias("n"))
    exact = pairs.groupBy("h").agg(F.count("*").alias("sites")).where(F.col("sites") >= min_sites).select("h")
    return sure.unionByName(exact)


def _line_table(spread: DataFrame, n: int) -> Column:
    """All hashes h, dealt by their remainder to n buckets, as one scalar: an array of arrays."""
    dealt = spread.groupBy(F.pmod("h", F.lit(n)).alias("k")).agg(F.collect_list("h").alias("hs"))
    places = spread.sparkSession.range(n).withColumnRenamed("id", "k").join(dealt, "k", "left")
    rows = F.array_sort(F.collect_list(F.struct("k", F.coalesce("hs", F.array().cast("array<bigint>")).alias("hs"))))
    return places.agg(F.transform(rows, lambda r: r["hs"]).alias("t")).scalar()


def drop_spread_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = 10, table_lines: int = TABLE_LINES) -> DataFrame:
    """One row per input row: doc_id, n_lines, n_removed, text (cleaned).

    Lines are what '\\n' separates, as they stand; an empty line never counts as repeated.  A null site
    is a site of its own.  Documents without such lines keep their text; null text gives the empty text.
    Texts are cleaned where they lie when at most table_lines lines go, and shuffle otherwise.
    """
    text = text_of(text_col)
    base = docs.select(column(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(F.coalesce(column(site_col).cast("string"), F.lit("\x00"))).alias("site"))
    line = F.filter(F.array_distinct(F.split("text", "\n", -1)), lambda x: x != "")
    lines = stash(base.select("site", F.explode(line).alias("line")).select("site", F.xxhash64("line").alias("h")), "lines")
    spread = stash(spread_lines(lines, min_sites), "boilerplate")
    parts = F.split("text", "\n", -1)
    n = spread.limit(table_lines + 1).count()
    if n <= table_lines:
        table = _line_table(spread, max(n, 1))
        gone = lambda x: F.array_contains(F.get(F.col("t"), F.pmod(F.xxhash64(x), F.lit(max(n, 1))).cast("int")), F.xxhash64(x))
        made = base.withColumn("t", table).select("doc_id", F.size(parts).alias("n_lines"), F.filter(parts, lambda x: ~gone(x)).alias("c"))
    else:
        # a line's own document is known by id and text hash, so that repeated ids keep their own lines
        held = base.select("doc_id", F.xxhash64("text").alias("th"), F.explode(line).alias("line")).select("doc_id", "th", F.xxhash64("line").alias("h"))
        drops = held.join(spread, "h", "left_semi").groupBy(F.col("doc_id").alias("_d"), F.col("th").alias("_t")).agg(F.collect_set("h").alias("drop"))
        found = base.withColumn("th", F.xxhash64("text")).join(drops, (F.col("th") == F.col("_t")) & F.col("doc_id").eqNullSafe(F.col("_d")), "left")
        clean = F.when(F.col("drop").isNull(), parts).otherwise(F.filter(parts, lambda x: ~F.array_contains(F.col("drop"), F.xxhash64(x))))
        made = found.select("doc_id", F.size(parts).alias("n_lines"), clean.alias("c"))
    return made.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), (F.col("n_lines") - F.size("c")).cast("long").alias("n_removed"), F.array_join("c", "\n").alias("text"))
