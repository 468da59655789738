"""Bars from trades: calendar, chained, volume-clock; and columns derived from bars.

Every operator takes explicit keys (symbol) and an explicit order (ts, seq); nothing depends on row position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scan import blocks, running_sum

#: Interval tokens and the widths they stand for; 1M is a calendar month.
INTERVALS = {"1m": "1 minute", "5m": "5 minutes", "15m": "15 minutes", "1h": "1 hour", "4h": "4 hours", "1d": "1 day", "3d": "3 days", "1w": "7 days"}
#: What an interval is resampled from where a source lacks it.
FALLBACK = {"4h": "1h", "3d": "1d", "1w": "1d"}


def bucket(ts: Column, width: str) -> Column:
    """Start of the bucket; width is an interval, a token of INTERVALS, or '1M' for calendar months."""
    if width == "1M":
        return F.date_trunc("month", ts)
    return F.window(ts, INTERVALS.get(width, width))["start"]


def resample(df: DataFrame, width: str, price: str = "price", order: tuple[str, ...] = ("ts", "seq"), aggregates: dict[str, Column] | None = None) -> DataFrame:
    """OHLCV per symbol and bucket from trades, or from bars if df has open, high, low, close.

    Open and close are the first and last by order; empty buckets do not appear.  aggregates are other columns by name, as
    aggregate expressions over df, in place of OHLCV.  One partially aggregated shuffle on (symbol, bucket), no
    sort of the tape.
    """
    if aggregates is not None:
        made = df.withColumn("_bucket", bucket(F.col("ts"), width)).groupBy("symbol", "_bucket").agg(*[c.alias(name) for name, c in aggregates.items()])
        return made.withColumnRenamed("_bucket", "ts").select("symbol", "ts", *aggregates)
    is_bars = {"open", "high", "low", "close"} <= set(df.columns)
    o, h, l, c = ("open", "high", "low", "close") if is_bars else (price,) * 4  # noqa: E741
    keys = [k for k in order if k in df.columns]
    at = F.struct(*keys)
    start = bucket(F.col("ts"), width)
    grouped = df.withColumn("_bucket", start).groupBy("symbol", "_bucket").agg(
        F.min_by(o, at).alias("open"), F.max(h).alias("high"), F.min(l).alias("low"), F.max_by(c, at).alias("close"), F.sum("volume").cast("double").alias("volume")
    )
    return grouped.withColumnRenamed("_bucket", "ts").select("symbol", "ts", "open", "high", "low", "close", "volume")


def collapse_repeated(trades: DataFrame) -> DataFrame:
    """Trades of one instant become one: volume-weighted price (null without volume) and total volume."""
    return trades.groupBy("symbol", "ts").agg(F.try_divide(F.sum(F.col("price") * F.col("volume")), F.sum("volume")).alias("price"), F.sum("volume").alias("volume"))


def calendar_bars(trades: DataFrame, seconds: float) -> DataFrame:
    """Bars anchored on a symbol's first trade: open chains to the close before, stamp is the bucket's end; VWAP."""
    by = Window.partitionBy("symbol")
    t = F.unix_micros("ts") / 1e6
    first = F.min(t).over(by)
    j = F.floor((t - first) / seconds)
    at = F.struct("ts", "seq")
    own = trades.withColumn("_first", first).withColumn("j", j).groupBy("symbol", "j").agg(
        F.min("_first").alias("_first"), F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"),
        F.sum("volume").alias("volume"), F.try_divide(F.sum(F.col("price") * F.col("volume")), F.sum("volume")).alias("vwap"),
    )
    chained = F.coalesce(F.lag("close").over(by.orderBy("j")), F.col("open"))
    return own.select("symbol", "j", (F.col("_first") + (F.col("j") + 1) * seconds).alias("stamp"), chained.alias("open"), F.greatest("high", chained).alias("high"), F.least("low", chained).alias("low"), "close", "volume", "vwap")


def volume_bars(trades: DataFrame, shares: int) -> DataFrame:
    """Bars of an equal number of shares; a trade that spans a border is split; the unfilled tail is dropped.

    VWAP weighs each trade by its shares in the bar.  The bar closes at its last trade.
    """
    run = running_sum(trades.where("volume > 0"), ["symbol"], ["ts", "seq"], F.col("volume"), blocks(trades, "ts"), "c1")
    cut = run.withColumn("c0", F.col("c1") - F.col("volume"))
    parts = cut.withColumn("k", F.explode(F.sequence(F.floor(F.col("c0") / shares), F.floor((F.col("c1") - 1) / shares))))
    own = F.least("c1", (F.col("k") + 1) * shares) - F.greatest("c0", F.col("k") * shares)
    at = F.struct("ts", "seq")
    grouped = parts.withColumn("own", own).groupBy("symbol", "k").agg(
        (F.sum(F.col("price") * F.col("own")) / F.sum("own")).alias("vwap"), F.sum("own").alias("volume"), F.max("ts").alias("ts"), F.max_by("price", at).alias("close"), F.max("price").alias("high"), F.min("price").alias("low")
    )
    return grouped.where(F.col("volume") == shares).drop("volume")


def panel(df: DataFrame, value: str, symbols: list[str] | None = None) -> DataFrame:
    """Wide view: one row per ts, one column per symbol, outer aligned.  Give symbols to spare a pass."""
    return df.groupBy("ts").pivot("symbol", symbols).agg(F.first(value))


def candle(df: DataFrame, floor: float = 1e-9) -> DataFrame:
    """Add up, body (never 0) and bottom of each bar."""
    return df.withColumns({"up": F.col("close") >= F.col("open"), "body": F.greatest(F.abs(F.col("close") - F.col("open")), F.lit(floor)), "bottom": F.least("open", "close")})


def norm100(points: Column) -> Column:
    """An array scaled to 0..100; all equal gives 0."""
    low, span = F.array_min(points), F.array_max(points) - F.array_min(points)
    return F.transform(points, lambda x: F.when(span == 0, F.lit(0.0)).otherwise((x - low) / span * 100))


def last_n(df: DataFrame, n: int) -> DataFrame:
    """The last n rows of each symbol by ts."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ts")))).where(F.col("_r") <= n).drop("_r")


def supervised(df: DataFrame, feature_cols: list[str], target: str = "close") -> DataFrame:
    """Features of the bar before beside this bar's target; a symbol's first bar drops."""
    w = Window.partitionBy("symbol").orderBy("ts")
    return df.select("symbol", "ts", *[F.lag(c).over(w).alias(f"x_{c}") for c in feature_cols], F.col(target).alias("y"), F.row_number().over(w).alias("_k")).where("_k > 1").drop("_k")


def split_by_time(df: DataFrame, n_train: int) -> DataFrame:
    """Add is_train: the first n_train rows of each symbol."""
    return df.withColumn("is_train", F.row_number().over(Window.partitionBy("symbol").orderBy("ts")) <= n_train)


def zscore(df: DataFrame, cols: list[str]) -> DataFrame:
    """Scale by the mean and population deviation of each symbol's training rows; a flat column gives null."""
    train = df.where("is_train").groupBy("symbol").agg(*[f(c).alias(f"_{k}_{c}") for c in cols for k, f in (("m", F.avg), ("s", F.stddev_pop))])
    joined = df.join(train, "symbol")
    return joined.withColumns({c: F.try_divide(F.col(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}")) for c in cols}).drop(*[f"_{k}_{c}" for c in cols for k in "ms"])


def synchronised_volume_bars(trades: DataFrame, size: int) -> DataFrame:
    """Volume bars of all symbols on one volume clock: tau, symbol, k, price, ts; a symbol without a row at a tau has no bar there.

    All symbols share the bucket size.  A symbol's k-th bucket closes at the first instant at which its volume passes
    (k + 1) * size; price is the bucket's volume-weighted one.  tau counts closings: those of one instant share a
    tau, and when a symbol closes several buckets in one instant, its first ones, second ones and so on do.  The count
    runs over days of closings and then inside each day, so no task has all of them.
    """
    instants = trades.where("volume > 0").groupBy("symbol", "ts").agg(F.sum("volume").alias("volume"))
    run = running_sum(instants, ["symbol"], ["ts"], F.col("volume"), blocks(instants, "ts"), "c1").withColumn("c0", F.col("c1") - F.col("volume"))
    first, last = F.greatest(F.ceil(F.col("c0") / size), F.lit(1)), F.ceil(F.col("c1") / size) - 1
    closed = run.where(last >= first).select("symbol", "ts", F.posexplode(F.sequence(first, last)).alias("drain", "k1")).select("symbol", "ts", "drain", (F.col("k1") - 1).alias("k"))
    days = closed.select(F.to_date("ts").alias("day"), "ts", "drain").distinct()
    counts = days.groupBy("day").agg(F.count("*").alias("n"))
    starts = counts.withColumn("start", F.sum("n").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).drop("n")
    ticks = days.withColumn("i", F.row_number().over(Window.partitionBy("day").orderBy("ts", "drain"))).join(starts, "day")
    prices = volume_bars(trades, size).select("symbol", "k", F.col("vwap").alias("price"))
    return closed.join(ticks.select("ts", "drain", (F.col("start") + F.col("i")).alias("tau")), ["ts", "drain"]).join(prices, ["symbol", "k"]).select("tau", "symbol", "k", "price", "ts")
