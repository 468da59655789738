"""Shards of near equal bytes by a k-d tree over metadata.

All nodes of a level split in the same few jobs: along its widest dimension, at the weighted median of its bytes.
The medians are found by histograms: each round sums bytes per 20-bit digit of the key inside the digit
range found before and takes the digit where a node's running sum passes half.  Sums and tree are tables; nothing that
grows with the rows or the leaves reaches the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, column, stash, text_of

#: A key has the dimension's 20 bits, then 40 bits of the text's hash, so that equal texts share it.
DIM_BITS, HASH_BITS, DIGIT = 20, 40, 20


def _medians(keyed: DataFrame, nodes: DataFrame, small: bool) -> DataFrame:
    """nodes (node, aim, ...) with cut, the key of its rows where the running bytes reach aim, the bytes before that key
    and on it.  keyed: node, key, size."""
    state = nodes.withColumns({"cut": F.lit(0).cast("long"), "before": F.lit(0).cast("long"), "on": F.lit(0).cast("long")})
    order = Window.partitionBy("node").orderBy("k")
    for shift in range(DIM_BITS + HASH_BITS - DIGIT, -1, -DIGIT):
        at = state.select(F.col("node").alias("at"), F.col("cut").alias("prefix"))
        inside = keyed.join(F.broadcast(at) if small else at, (F.col("node") == F.col("at")) & (F.shiftright("key", shift + DIGIT) == F.col("prefix")))
        sums = inside.groupBy("node", F.shiftright("key", shift).alias("k")).agg(F.sum("size").alias("w"))
        run = sums.withColumns({"upto": F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, 0)), "end": F.sum("w").over(Window.partitionBy("node"))})
        passed = run.join(F.broadcast(state) if small else state, "node").where((F.col("before") + F.col("upto") >= F.col("aim")) | (F.col("upto") == F.col("end")))
        first = passed.groupBy(*nodes.columns).agg(F.min(F.struct("k", (F.col("before") + F.col("upto") - F.col("w")).alias("b"), "w")).alias("f"))
        state = stash(first.select(*nodes.columns, F.col("f.k").alias("cut"), F.col("f.b").alias("before"), F.col("f.w").alias("on")), "kdmedian")
    return state


def cut_order() -> Column:
    """Where a row of (doc_id, th, rid) stands among rows of one key: by a hash of id and text, repeated rows by one of their number; 60 bits."""
    half = F.lit(1 << 30)
    return F.shiftleft(F.pmod(F.xxhash64("doc_id", "th"), half), 30) + F.pmod(F.xxhash64("rid"), half)


def kd_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", dims: dict[str, Column] | None = None, n_shards: int = 8, target_bytes: int | None = None, tolerance: float = 0.005, rows_per_slot_block: int = 100_000) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, shard, slot.

    size is the text's UTF-8 bytes plus 1 (null: 1).  dims are numeric metadata (null: 0); the default
    measures the text: bytes, bytes per code point and first line's length.  With target_bytes the number
    of shards is the total over it, rounded up.  Equal texts stay together where that moves a
    cut by no more than tolerance of the node's bytes, else the cut goes through them, at the median of their bytes in the order of a
    hash of id and text, and goes through repeated rows too.  So a cut is off by no more than tolerance or half a row, however often rows repeat, and
    which ids go where does not depend on the files' layout.  Slots count from 0 in each shard without gaps, in no
    order of meaning.  An empty table gives no rows.
    """
    text = text_of(text_col)
    size = (F.octet_length(text) + 1).cast("long")
    dims = dims or {"bytes": size, "width": F.octet_length(text) / F.greatest(F.char_length(text), F.lit(1)), "head": F.locate("\n", text)}
    names = [f"d{i}" for i in range(len(dims))]
    base = stash(
        docs.select(
            column(id_col).alias("doc_id"), size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("th"), F.monotonically_increasing_id().alias("rid"),
            *[F.coalesce(c.cast("double"), F.lit(0.0)).alias(n) for n, c in zip(names, dims.values(), strict=True)],
        ),
        "kd",
    )
    ends = base.agg(F.sum("size").alias("w"), F.count("*").alias("n"), *[f(n).alias(f"{k}{n}") for n in names for k, f in (("lo", F.min), ("hi", F.max))]).first()
    scale = [F.floor((F.col(n) - ends[f"lo{n}"]) / max(ends[f"hi{n}"] - ends[f"lo{n}"], 1e-12) * (2**DIM_BITS - 1)).cast("long") for n in names] if ends.n else [F.lit(0).cast("long") for n in names]
    leaves = max(1, math.ceil(ends.w / target_bytes)) if target_bytes and ends.n else n_shards
    rows = base.select("doc_id", "size", "text_crc32", "th", cut_order().alias("r"), F.pmod(F.xxhash64("rid", "th"), F.lit(1 << 30)).alias("spread"), F.array(*scale).alias("d"), F.lit(0).cast("long").alias("node"))
    # share: shards below a node; first: the number of the first of them.  The children of n are 2n + 1 and 2n + 2
    tree = base.sparkSession.range(1).select(F.col("id").alias("node"), F.lit(leaves).cast("long").alias("share"), F.lit(0).cast("long").alias("first"))
    for level in range(math.ceil(math.log2(leaves)) if ends.n else 0):
        small = 2**level <= BROADCAST_ROWS
        spans = [F.max(F.col("d")[i]) - F.min(F.col("d")[i]) for i in range(len(names))]
        stats = rows.groupBy("node").agg(F.sum("size").alias("bytes"), F.array(*spans).alias("s")).join(tree.where("share > 1"), "node")
        low = F.floor(F.col("share") / 2)
        nodes = stash(stats.select("node", "bytes", "share", "first", (F.array_position("s", F.array_max("s")) - 1).cast("int").alias("axis"), (F.col("bytes") * low / F.col("share")).alias("aim")), "kdnodes")

        def keyed(known: DataFrame, how: str, rows: DataFrame = rows, small: bool = small) -> DataFrame:
            known = known.withColumnRenamed("node", "own")
            met = rows.join(F.broadcast(known) if small else known, F.col("node") == F.col("own"), how)
            return met.withColumn("key", F.shiftleft(F.get("d", "axis"), HASH_BITS) + F.pmod("th", F.lit(1 << HASH_BITS)))

        found = _medians(keyed(nodes.select("node", "axis"), "inner").select("node", "key", "size"), nodes, small)
        part = F.when(F.col("on") > 0, (F.col("aim") - F.col("before")) / F.col("on")).otherwise(0.0)
        nearest = F.when(part < 0.5, 0.0).otherwise(1.0)
        # rows on the cut's key with an order below `upto` go left: none, all, or those up to the median among them
        whole = F.abs(nearest - part) * F.col("on") <= tolerance * F.col("bytes")
        found = found.withColumn("upto", F.when(whole, nearest.cast("long") * F.lit(1 << 62)))
        through = stash(found.where("upto is null").select("node", "axis", F.col("cut").alias("kcut"), (F.col("aim") - F.col("before")).alias("aim")), "kdthrough")
        if not through.isEmpty():
            on_cut = keyed(through.select("node", "axis", "kcut"), "inner").where("key = kcut").select("node", F.col("r").alias("key"), "size")
            inner = _medians(on_cut, through, small)
            left = (F.col("aim") - F.col("before") >= F.col("on") / 2).cast("long")
            inner = inner.select(F.col("node").alias("at"), (F.col("cut") + left).alias("within"))
            found = found.join(F.broadcast(inner) if small else inner, F.col("node") == F.col("at"), "left").withColumn("upto", F.coalesce("upto", "within"))
            found = stash(found.drop("at", "within"), "kdcut")
        right = F.coalesce((F.col("key") > F.col("cut")) | ((F.col("key") == F.col("cut")) & (F.col("r") >= F.col("upto"))), F.lit(False))
        split = keyed(found.select("node", "axis", "cut", "upto"), "left")
        rows = split.select("doc_id", "size", "text_crc32", "th", "r", "spread", "d", F.when(F.col("cut").isNull(), F.col("node")).otherwise(2 * F.col("node") + 1 + right.cast("int")).alias("node"))
        halves = F.array(F.struct((2 * F.col("node") + 1).alias("node"), low.alias("share"), F.col("first")), F.struct((2 * F.col("node") + 2).alias("node"), (F.col("share") - low).alias("share"), (F.col("first") + low).alias("first")))
        tree = tree.where("share = 1").unionByName(found.select(F.inline(halves)))
        if level % 3 == 2:
            rows, tree = stash(rows, "kdrows"), stash(tree, "kdtree")
    numbers = tree.select(F.col("node").alias("leaf"), F.col("first").cast("int").alias("shard"))
    numbers = F.broadcast(numbers) if leaves <= BROADCAST_ROWS else numbers
    blocks = max(1, math.ceil(ends.n / rows_per_slot_block))
    placed = stash(rows.join(numbers, F.col("node") == F.col("leaf")).select("doc_id", "size", "text_crc32", "shard", "spread", (F.col("spread") % blocks).cast("int").alias("block")), "placed")
    counts = placed.groupBy("shard", "block").count()
    starts = counts.withColumn("start", F.coalesce(F.sum("count").over(Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    local = F.row_number().over(Window.partitionBy("shard", "block").orderBy("spread", "doc_id")) - 1
    return placed.withColumn("local", local).join(starts, ["shard", "block"]).select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("local")).cast("long").alias("slot"))
