"""Technical indicators as window expressions; recursive ones as folds over bounded arrays."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import special


def _frame(n: int, key: str = "symbol", ts: str = "ts"):  # noqa: ANN202
    return Window.partitionBy(key).orderBy(ts).rowsBetween(-n + 1, 0)


def sma(x: str, n: int) -> Column:
    return F.avg(x).over(_frame(n))


def bollinger(x: str, n: int = 20, k: float = 2.0) -> dict[str, Column]:
    mid, sd = F.avg(x).over(_frame(n)), F.stddev_pop(x).over(_frame(n))
    return {"bb_mid": mid, "bb_low": mid - k * sd, "bb_high": mid + k * sd}


def ema(x: str, n: int, tail: int | None = None) -> Column:
    """Exponential mean with weight 2 / (n + 1), seeded with the frame's first value; older rows than `tail` weigh
    less than 1e-9 and are left out, so a row needs a bounded frame."""
    a = 2 / (n + 1)
    tail = tail or math.ceil(math.log(1e-9) / math.log(1 - a)) if n > 1 else 1
    past = F.collect_list(x).over(_frame(tail))
    return F.aggregate(F.slice(past, 2, tail), F.element_at(past, 1), lambda acc, v: acc * (1 - a) + v * a)


def rsi(df: DataFrame, n: int = 14) -> DataFrame:
    """Relative strength by simple means of gains and losses over n changes; no loss gives 100."""
    w = Window.partitionBy("symbol").orderBy("ts")
    d = df.withColumn("_d", F.col("close") - F.lag("close").over(w))
    gain, loss = F.avg(F.greatest("_d", F.lit(0.0))).over(_frame(n)), F.avg(F.greatest(-F.col("_d"), F.lit(0.0))).over(_frame(n))
    return d.withColumn("rsi", F.when(loss == 0, 100.0).otherwise(100 - 100 / (1 + gain / loss))).drop("_d")


def stochastic(df: DataFrame, n: int = 14) -> DataFrame:
    low, high = F.min("low").over(_frame(n)), F.max("high").over(_frame(n))
    return df.withColumn("pct_k", F.try_divide((F.col("close") - low) * 100, high - low))


def money_flow(df: DataFrame, n: int = 14) -> DataFrame:
    """Money flow index over n typical prices; no negative flow gives 100."""
    w = Window.partitionBy("symbol").orderBy("ts")
    tp = (F.col("high") + F.col("low") + F.col("close")) / 3
    d = df.withColumn("_tp", tp).withColumn("_mf", F.col("_tp") * F.col("volume")).withColumn("_up", F.col("_tp") - F.lag("_tp").over(w))
    up, down = F.sum(F.when(F.col("_up") > 0, F.col("_mf")).otherwise(0.0)).over(_frame(n)), F.sum(F.when(F.col("_up") < 0, F.col("_mf")).otherwise(0.0)).over(_frame(n))
    return d.withColumn("mfi", F.when(down == 0, 100.0).otherwise(100 - 100 / (1 + up / down))).drop("_tp", "_mf", "_up")


def atr(df: DataFrame, n: int = 14) -> DataFrame:
    before = F.lag("close").over(Window.partitionBy("symbol").orderBy("ts"))
    tr = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))
    return df.withColumn("_tr", tr).withColumn("atr", F.avg("_tr").over(_frame(n))).drop("_tr")


def aroon(df: DataFrame, n: int = 14) -> DataFrame:
    """Share of the last n bars since the highest high and the lowest low, in percent; the later of equals counts."""
    f = _frame(n + 1)
    last = F.count("*").over(Window.partitionBy("symbol").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0))
    rows = df.withColumn("_i", last)
    top, bottom = F.max(F.struct("high", "_i")).over(f)["_i"], -F.min(F.struct(F.col("low"), (-F.col("_i")).alias("j"))).over(f)["j"]
    return rows.withColumns({"aroon_up": (n - (F.col("_i") - top)) * 100 / n, "aroon_down": (n - (F.col("_i") - bottom)) * 100 / n}).drop("_i")


def range_volatility(df: DataFrame, n: int = 20) -> DataFrame:
    """Parkinson, Garman-Klass, Rogers-Satchell and Yang-Zhang volatilities over n bars.

    Bars across zero make the frames that hold them NaN; means below zero of the second and third kind, which have no root, count as zero.
    """
    before = F.lag("close").over(Window.partitionBy("symbol").orderBy("ts"))
    hl, co, hc, ho, lc, lo = (special.log_ratio(F.col(a), F.col(b)) for a, b in (("high", "low"), ("close", "open"), ("high", "close"), ("high", "open"), ("low", "close"), ("low", "open")))
    rows = df.withColumn("_before", before).withColumns({"_pk": hl * hl / (4 * math.log(2)), "_gk": hl * hl / 2 - (2 * math.log(2) - 1) * co * co, "_rs": hc * ho + lc * lo, "_o": special.log_ratio(F.col("open"), F.col("_before")), "_c": co})
    f = _frame(n)
    k = 0.34 / (1.34 + (n + 1) / (n - 1))
    yz = F.var_samp("_o").over(f) + k * F.var_samp("_c").over(f) + (1 - k) * F.avg("_rs").over(f)
    return rows.withColumns({"parkinson": F.sqrt(F.avg("_pk").over(f)), "garman_klass": F.sqrt(F.greatest(F.avg("_gk").over(f), F.lit(0.0))), "rogers_satchell": F.sqrt(F.greatest(F.avg("_rs").over(f), F.lit(0.0))), "yang_zhang": F.sqrt(yz)}).drop("_before", "_pk", "_gk", "_rs", "_o", "_c")
