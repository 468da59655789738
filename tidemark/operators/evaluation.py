"""Evaluation of strategies: walk-forward folds, overfitting, penalties, bootstrap, regressions, feature pruning."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def walk_forward(df: DataFrame, train: int = 160, test: int = 40, key: str = "symbol", ts: str = "ts") -> DataFrame:
    """Rows dealt to folds of train + test rows that start every `test` rows: adds fold and part ('train', 'test')."""
    w = Window.partitionBy(key)
    i = F.row_number().over(w.orderBy(ts)) - 1
    n = F.count("*").over(w)
    rows = df.withColumns({"_i": i, "_n": n})
    first = F.greatest(F.lit(0), F.ceil((F.col("_i") - (train + test) + 1) / test))
    last = F.least(F.floor(F.col("_i") / test), F.floor((F.col("_n") - (train + test)) / test))
    folds = rows.where(last >= first).withColumn("fold", F.explode(F.sequence(first, last)))
    return folds.withColumn("part", F.when(F.col("_i") - F.col("fold") * test < train, "train").otherwise("test")).drop("_i", "_n")


def covariance_penalty(r2: Column, n: Column, trace: Column, sharpe: Column) -> dict[str, Column]:
    """Expected out-of-sample squared correlation and Sharpe ratio."""
    return {"r2_out": r2 - 2 / n * trace, "sharpe_out": sharpe - 2 * trace / n * F.pow(1 - sharpe * sharpe, 1.5)}


def overfitting_probability(returns: DataFrame, blocks: int = 6) -> DataFrame:
    """Combinatorially symmetric cross-validation: share of splits where the in-sample best is below the median outside (its logit below 0).

    returns: strategy, ts, ret.  Time is cut into `blocks` equal stretches by rank; each split trains on half of them.
    Moments per (strategy, block) come from one aggregation; splits are a small parameter table.
    """
    spark = returns.sparkSession
    # stretches of time by approximate quantiles of ts, so that no global sort is needed
    t = F.unix_micros("ts")
    cuts = returns.agg(F.percentile_approx(t, [k / blocks for k in range(1, blocks)], 10_000).alias("cuts"))
    dealt = returns.crossJoin(F.broadcast(cuts)).withColumn("block", F.size(F.filter("cuts", lambda c: t > c)))
    sums = dealt.groupBy("strategy", "block").agg(F.count("*").alias("n"), F.sum("ret").alias("s1"), F.sum(F.col("ret") ** 2).alias("s2"))
    splits = spark.createDataFrame([(i, b, b in chosen) for i, chosen in enumerate(combinations(range(blocks), blocks // 2)) for b in range(blocks)], "split int, block int, inside boolean")
    part = sums.join(F.broadcast(splits), "block").groupBy("split", "strategy", "inside").agg(F.sum("n").alias("n"), F.sum("s1").alias("s1"), F.sum("s2").alias("s2"))
    mean = F.col("s1") / F.col("n")
    part = part.withColumn("sharpe", F.try_divide(mean, F.sqrt(F.col("s2") / F.col("n") - mean * mean)))
    w = Window.partitionBy("split", "inside")
    ranked = part.withColumns({"rank": F.rank().over(w.orderBy("sharpe")), "total": F.count("*").over(w)})
    best = ranked.where("inside").withColumn("_r", F.row_number().over(Window.partitionBy("split").orderBy(F.desc("sharpe"), "strategy"))).where("_r = 1").select("split", "strategy")
    outside = best.join(ranked.where("not inside"), ["split", "strategy"])
    omega = F.col("rank") / (F.col("total") + 1)
    return outside.agg(F.count("*").alias("splits"), F.avg(F.ln(omega / (1 - omega))).alias("mean_logit"), F.avg((F.round(F.ln(omega / (1 - omega)), 12) < 0).cast("double")).alias("p_overfit"))


def moving_block_bootstrap(df: DataFrame, value: str, replicas: int, block: int, seed: int = 7, key: str = "symbol", ts: str = "ts") -> DataFrame:
    """Mean of `value` in each replica of a moving-block bootstrap: key, replica, mean.

    Draws are of blocks, and a block's sum is a window over rows, so a replica is a join of its drawn starts with
    block sums: n / block rows per replica, not n.
    """
    w = Window.partitionBy(key)
    i = F.row_number().over(w.orderBy(ts)) - 1
    rows = df.withColumns({"i": i, "n": F.count("*").over(w), "s": F.sum(value).over(w.orderBy(ts).rowsBetween(0, block - 1))}).select(key, "i", "n", "s")
    sizes = rows.groupBy(key).agg(F.first("n").alias("n"))
    draws = sizes.withColumn("replica", F.explode(F.sequence(F.lit(0), F.lit(replicas - 1)))).withColumn("draw", F.explode(F.sequence(F.lit(0), F.floor(F.col("n") / block).cast("int") - 1)))
    digest = F.md5(F.concat_ws("|", key, F.col("replica").cast("string"), F.col("draw").cast("string"), F.lit(str(seed))))
    start = F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % (F.col("n") - block + 1)
    drawn = draws.select(key, "replica", start.alias("i"))
    return drawn.join(rows.select(key, "i", "s"), [key, "i"]).groupBy(key, "replica").agg((F.sum("s") / (F.count("*") * block)).alias("mean"))


def scenario_paths(df: DataFrame, ret: str, paths: int, steps: int, block: int, seed: int = 7, key: str = "symbol", ts: str = "ts", start: float = 100.0) -> DataFrame:
    """Paths drawn from the returns there are: key, path, step, value, by moving blocks of them that begin at random places.

    A path is steps / block draws (steps a multiple of block); these meet the returns on their place, so neither a path nor a
    series is held by one task.
    """
    w = Window.partitionBy(key)
    rows = df.select(key, F.col(ret).alias("_r"), (F.row_number().over(w.orderBy(ts)) - 1).alias("_i"))
    sizes = rows.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") >= block)
    draws = sizes.withColumn("path", F.explode(F.sequence(F.lit(0), F.lit(paths - 1)))).withColumn("_d", F.explode(F.sequence(F.lit(0), F.lit(steps // block - 1))))
    digest = F.md5(F.concat_ws("|", key, F.col("path").cast("string"), F.col("_d").cast("string"), F.lit(str(seed))))
    begin = F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % (F.col("_n") - block + 1)
    places = draws.withColumn("_b", begin).withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(block - 1))))
    drawn = places.select(key, "path", (F.col("_d") * block + F.col("_o") + 1).alias("step"), (F.col("_b") + F.col("_o")).alias("_i")).join(rows, [key, "_i"])
    run = Window.partitionBy(key, "path").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return drawn.select(key, "path", "step", (start * F.exp(F.sum("_r").over(run))).alias("value"))


def two_factor(df: DataFrame, y: str, x1: str, x2: str, by: list[str]) -> DataFrame:
    """Alpha and two betas by the normal equations of one grouped aggregation."""
    v1, v2, c12 = F.var_pop(x1), F.var_pop(x2), F.covar_pop(x1, x2)
    c1, c2 = F.covar_pop(y, x1), F.covar_pop(y, x2)
    out = df.groupBy(*by).agg(F.avg(y).alias("_y"), F.avg(x1).alias("_x1"), F.avg(x2).alias("_x2"), ((c1 * v2 - c2 * c12) / (v1 * v2 - c12 * c12)).alias("beta1"), ((c2 * v1 - c1 * c12) / (v1 * v2 - c12 * c12)).alias("beta2"))
    return out.select(*by, (F.col("_y") - F.col("beta1") * F.col("_x1") - F.col("beta2") * F.col("_x2")).alias("alpha"), "beta1", "beta2")


def prune_correlated(df: DataFrame, cols: list[str], limit: float = 0.6) -> list[str]:
    """Features in order, without those whose correlation with a kept one exceeds limit in size.  One aggregation."""
    pairs = list(combinations(cols, 2))
    row = df.agg(*[F.corr(a, b).alias(f"{i}") for i, (a, b) in enumerate(pairs)]).first() if pairs else []
    close = {p for p, r in zip(pairs, row, strict=True) if r is not None and abs(r) > limit}
    kept: list[str] = []
    for c in cols:
        if not any((k, c) in close for k in kept):
            kept.append(c)
    return kept


def holding_periods(df: DataFrame, signal: str, ret: str, longest: int = 10, key: str = "symbol", ts: str = "ts") -> DataFrame:
    """Mean P&L in bp of holding sign(signal) over the next h rows, h = 1..longest."""
    w = Window.partitionBy(key).orderBy(ts)
    wide = df.select(F.signum(signal).alias("s"), *[F.when(F.lead(ret, h).over(w).isNotNull(), F.sum(ret).over(w.rowsBetween(1, h))).alias(f"f{h}") for h in range(1, longest + 1)])
    row = wide.agg(*[(F.avg(F.col("s") * F.col(f"f{h}")) * 1e4).alias(str(h)) for h in range(1, longest + 1)])
    return row.unpivot([], [str(h) for h in range(1, longest + 1)], "h", "pnl_bp").withColumn("h", F.col("h").cast("int"))


def decay(df: DataFrame, ret: str, live: Column, key: str = "symbol", target: float = 0.1, year: int = 252) -> DataFrame:
    """Volatility-adjusted return before and after going live, and the change: key, proforma, live, decay (per year, at target volatility)."""
    adjusted = F.avg(ret) / F.stddev_samp(ret) * year**0.5 * target
    parts = df.withColumn("_live", live).groupBy(key, "_live").agg(adjusted.alias("r"))
    made = parts.groupBy(key).agg(F.max(F.when(~F.col("_live"), F.col("r"))).alias("proforma"), F.max(F.when(F.col("_live"), F.col("r"))).alias("live"))
    return made.withColumn("decay", F.col("live") - F.col("proforma"))


def haircut(proforma: Column, regime: Column, slope: float = 0.137, cost: float = 5.0) -> Column:
    """Live return, in percent, to be expected of a pro-forma one at a regime's z-score (fixed values: the slopes)."""
    return slope * proforma - cost * regime


def coverage_tests(df: DataFrame, hit: Column, alpha: float, key: str = "symbol", ts: str = "ts") -> DataFrame:
    """Likelihood ratios of value-at-risk breaches: key, n, hits, lr_coverage (share against alpha), lr_independence (a breach
    after a breach against one after none)."""
    w = Window.partitionBy(key).orderBy(ts)
    rows = df.select(key, hit.cast("int").alias("h"), F.lag(hit.cast("int")).over(w).alias("b"))
    c = lambda b, h: F.count_if((F.col("b") == b) & (F.col("h") == h)).cast("double").alias(f"n{b}{h}")
    n = rows.groupBy(key).agg(F.count("*").alias("n"), F.sum("h").alias("hits"), c(0, 0), c(0, 1), c(1, 0), c(1, 1))

    def log_lik(no: Column, yes: Column, p: Column) -> Column:
        return F.when(no > 0, no * F.ln(1 - p)).otherwise(0.0) + F.when(yes > 0, yes * F.ln(p)).otherwise(0.0)

    p0, p1 = (F.try_divide(F.col(f"n{b}1"), F.col(f"n{b}0") + F.col(f"n{b}1")) for b in (0, 1))
    both = (F.col("n01") + F.col("n11")) / (F.col("n00") + F.col("n01") + F.col("n10") + F.col("n11"))
    coverage = 2 * (log_lik(F.col("n") - F.col("hits"), F.col("hits"), F.col("hits") / F.col("n")) - log_lik(F.col("n") - F.col("hits"), F.col("hits"), F.lit(alpha)))
    apart = log_lik(F.col("n00"), F.col("n01"), p0) + F.coalesce(log_lik(F.col("n10"), F.col("n11"), p1), F.lit(0.0))
    independence = 2 * (apart - log_lik(F.col("n00") + F.col("n10"), F.col("n01") + F.col("n11"), both))
    return n.select(key, "n", "hits", coverage.alias("lr_coverage"), independence.alias("lr_independence"))


def principal_shares(wide: DataFrame, cols: list[str]) -> list[float]:
    """Shares of the variance along the principal components of the correlation of cols: the correlations are one aggregation,
    their eigenvalues the driver's (as many numbers as columns squared)."""
    import numpy as np

    pairs = [(a, b) for a in cols for b in cols]
    row = wide.agg(*[F.corr(a, b).alias(f"{i}") for i, (a, b) in enumerate(pairs)]).first()
    values = np.linalg.eigvalsh(np.array([float(x) for x in row]).reshape(len(cols), -1))[::-1]
    return (values / values.sum()).tolist()
