"""Joins on time: as-of, bracketing quotes, event windows, interval overlap, range buckets.

No join here compares all pairs: as-of joins are a union and a running last value, range joins meet in
time buckets with the range as a residual predicate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scan import blocks, day_of, running_last


def asof_join(left: DataFrame, right: DataFrame, value: str, key: str = "symbol", ts: str = "ts", order: str | None = None) -> DataFrame:
    """Each left row with the last right value at or before its time, null if none; rows are never multiplied.

    order breaks ties among right rows of one instant.  Timestamps run in blocks of a day, other orders in one; the tie of left and right goes to right first.
    """
    seq = F.col(order) if order else F.lit(0)
    data = F.struct(*[F.col(c) for c in left.columns])
    both = left.select(F.col(key).alias("_k"), F.col(ts).alias("_t"), F.lit(1).alias("_side"), F.lit(0).cast("long").alias("_o"), data.alias("_row"), F.lit(None).cast(right.schema[value].dataType).alias("_v")).unionByName(
        right.select(F.col(key).alias("_k"), F.col(ts).alias("_t"), F.lit(0).alias("_side"), seq.cast("long").alias("_o"), F.lit(None).cast(left.select(data.alias("x")).schema["x"].dataType).alias("_row"), F.col(value).alias("_v"))
    )
    run = running_last(both, ["_k"], [F.col("_t"), F.col("_side"), F.col("_o")], "_v", blocks(both, "_t"), "_last")
    return run.where("_side = 1").select("_row.*", F.col("_last").alias(f"asof_{value}"))


def grid_asof(points: DataFrame, value: str, seconds: int) -> DataFrame:
    """Previous tick on a regular grid of each symbol from its first to its last tick, made from the ticks:
    a tick fills the grid times from its own to just before the next tick's."""
    w = Window.partitionBy("symbol").orderBy("ts", "seq")
    t = F.unix_seconds("ts")
    spans = points.withColumns({"_a": F.ceil(t / seconds), "_b": F.coalesce(F.ceil(F.lead(t).over(w) / seconds) - 1, F.floor(t / seconds))})
    return spans.where("_b >= _a").select("symbol", F.explode(F.sequence("_a", "_b")).alias("_g"), value).select("symbol", F.timestamp_seconds(F.col("_g") * seconds).alias("ts"), value)


def bracket_quotes(trades: DataFrame, quotes: DataFrame, pairs: DataFrame, keep: list[str] | None = None, times: bool = False) -> DataFrame:
    """For each pair (i, j) and trade of j: the last quote of i before it and the first one after it.

    pairs is (i, j).  A union per pair and two running values, in blocks of a day.  Quotes of one
    instant count in the order of their seq, where they have one.  keep names more columns of the trades; times adds the instants of both quotes in microseconds.
    """
    by = F.col("seq") if "seq" in quotes.columns else F.lit(0)
    us, more = F.unix_micros("ts"), keep or []
    quote = lambda price: F.struct(price.alias("price"), us.alias("us")) if times else price
    q = quotes.groupBy("symbol", "ts").agg(F.max_by("price", by).alias("last"), F.min_by("price", by).alias("first")).join(pairs.withColumnRenamed("i", "symbol"), "symbol")
    kinds = {f.name: f.dataType for f in trades.schema}
    q = q.select(F.col("symbol").alias("i"), "j", "ts", F.lit(0).alias("_side"), F.lit(None).cast("long").alias("seq"), F.lit(None).cast("string").alias("side"), *[F.lit(None).cast(kinds[c]).alias(c) for c in more], quote(F.col("last")).alias("last"), quote(F.col("first")).alias("first"))
    none = F.lit(None).cast(q.schema["last"].dataType)
    t = trades.join(pairs.withColumnRenamed("j", "symbol"), "symbol").select("i", F.col("symbol").alias("j"), "ts", F.lit(1).alias("_side"), "seq", "side", *more, none.alias("last"), none.alias("first"))
    # both frames grow row by row: one that ends at the partition's end is computed anew for each row
    both = running_last(q.unionByName(t), ["i", "j"], [us], "last", day_of("ts"), "before", rows=False)
    both = running_last(both, ["i", "j"], [-us], "first", day_of("ts"), "after", forward=False, rows=False)
    found = [F.col("before.price").alias("before"), F.col("after.price").alias("after"), F.col("before.us").alias("before_us"), F.col("after.us").alias("after_us")] if times else ["before", "after"]
    return both.where("_side = 1").select("i", "j", "ts", "seq", "side", *more, *found)


def event_windows(events: DataFrame, series: DataFrame, before: int, after: int) -> DataFrame:
    """Series rows at offsets -before..after around each event: equal symbol, minute within range.

    events is (symbol, event_id, minute), series (symbol, minute, ...).  Minutes meet in blocks as long as a
    window, so each event meets two or three blocks and not the whole series.
    """
    size = before + after + 1
    e = events.withColumn("_block", F.explode(F.sequence(F.floor((F.col("minute") - before) / size), F.floor((F.col("minute") + after) / size))))
    s = series.withColumn("_block", F.floor(F.col("minute") / size)).withColumnRenamed("minute", "_m")
    joined = e.join(s, ["symbol", "_block"]).withColumn("offset", F.col("_m") - F.col("minute")).where(F.col("offset").between(-before, after))
    return joined.drop("_block", "_m")


def interval_overlap(a: DataFrame, b: DataFrame, width: float, key: list[str] | None = None) -> DataFrame:
    """Pairs of half-open intervals (t0, t1] and (u0, u1] that overlap: t0 < u1 and u0 < t1.

    a has t0, t1 and b has u0, u1 (seconds).  Both are dealt to the time buckets of the given width that they touch; a
    pair is reported once, in the bucket where the later of the two starts.
    """
    x = a.withColumn("_w", F.explode(F.sequence(F.floor(F.col("t0") / width), F.floor(F.col("t1") / width))))
    y = b.withColumn("_w", F.explode(F.sequence(F.floor(F.col("u0") / width), F.floor(F.col("u1") / width))))
    joined = x.join(y, ["_w", *(key or [])]).where((F.col("t0") < F.col("u1")) & (F.col("u0") < F.col("t1")))
    return joined.where(F.floor(F.greatest("t0", "u0") / width) == F.col("_w")).drop("_w")


def leave_one_out(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Add loo: the mean of the other rows of the same group, null alone; no self-join."""
    w = Window.partitionBy(*by)
    return df.withColumn("loo", F.try_divide(F.sum(value).over(w) - F.col(value), F.count(value).over(w) - 1))
