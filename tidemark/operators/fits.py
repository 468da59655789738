"""Fits that need iteration: each group's data is one bounded task, or the sums that a step needs are aggregated by Spark."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import special
from .shared import stash
from .stats import detrended_covariance


def power_law_bootstrap(samples: DataFrame, x: str, cutoffs: list[float], replicas: int = 200, seed: int = 1, least: int = 10) -> DataFrame:
    """x_min, n, delta, ks and p of the tail's fit at the cutoff nearest to its law: p is the share of samples drawn from the
    fit whose own best fit, its cutoff chosen anew, is farther off.

    Replicas are rows dealt over tasks; each draws as many values as the tail has, so a task's memory grows with the tail.
    """
    from .stats import best_cutoff, power_law

    fit = best_cutoff(power_law(samples, x, cutoffs), least=least)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        n, delta, low = int(pdf.n.iloc[0]), float(pdf.delta.iloc[0]), float(pdf.x_min.iloc[0])
        out = []
        for i in pdf.replica.tolist():
            drawn, far = np.sort(low * np.random.default_rng([seed, i]).random(n) ** (-1 / (delta - 1))), []
            for cut in [low, *(c for c in cutoffs if c > low)]:
                v = drawn[np.searchsorted(drawn, cut) :] / cut
                if len(v) >= least or cut == low:
                    model, k = 1 - v ** (-len(v) / np.log(v).sum()), np.arange(1, len(v) + 1) / len(v)
                    far.append(max(np.abs(k - model).max(), np.abs(k - 1 / len(v) - model).max()))
            out.append(min(far))
        return pd.DataFrame({"x_min": low, "ks_drawn": out})

    many = fit.withColumn("replica", F.explode(F.sequence(F.lit(0), F.lit(replicas - 1)))).withColumn("part", F.col("replica") % 16)
    drawn = many.groupBy("part").applyInPandas(run, "x_min double, ks_drawn double")
    return fit.join(drawn, "x_min").groupBy("x_min", "n", "delta", "ks").agg(F.avg((F.col("ks_drawn") > F.col("ks")).cast("double")).alias("p"))


def conditional_intervals(gaps: DataFrame, tau: str = "tau", parts: int = 4, key: str = "symbol", order: str = "bar_idx") -> DataFrame:
    """Memory of recurrence: mean next gap after gaps of each quantile part, over the overall mean."""
    w = Window.partitionBy(key, "q")
    rows = gaps.withColumns({"next": F.lead(tau).over(w.orderBy(order)), "part": F.ntile(parts).over(w.orderBy(tau, order)), "all": F.avg(tau).over(w)}).where("next is not null")
    return rows.groupBy(key, "q", "part").agg((F.avg("next") / F.first("all")).alias("ratio"), F.count("*").alias("n"))


def conditional_density(gaps: DataFrame, tau: str = "tau", parts: int = 4, width: float = 0.5, key: str = "symbol", order: str = "bar_idx") -> DataFrame:
    """Density of the scaled next gap after gaps of each quantile part, keys and thresholds pooled: part, bin, n, density."""
    w = Window.partitionBy(key, "q")
    rows = gaps.withColumns({"next": F.lead(tau).over(w.orderBy(order)) / F.avg(tau).over(w), "part": F.ntile(parts).over(w.orderBy(tau, order))}).where("next is not null")
    counts = rows.groupBy("part", F.floor(F.col("next") / width).alias("bin")).agg(F.count("*").alias("n"))
    return counts.withColumn("density", F.col("n") / F.sum("n").over(Window.partitionBy("part")) / width)


def dfa(df: DataFrame, x: str, scales: list[int], key: str = "symbol", order: str = "bar_idx") -> DataFrame:
    """Detrended fluctuation exponent: slope of ln F against ln s."""
    f = detrended_covariance(df, x, x, scales, key, order).groupBy(key, "s").agg(F.sqrt(F.avg("f2")).alias("f"))
    return f.groupBy(key).agg(F.regr_slope(F.ln("f"), F.ln("s")).alias("exponent"))


def shuffled(df: DataFrame, x: str, key: str = "symbol", order: str = "bar_idx", seed: int = 1) -> DataFrame:
    """The surrogate: x of each key in random order over the same places."""
    w = Window.partitionBy(key)
    places = df.select(key, order, F.row_number().over(w.orderBy(order)).alias("_i"))
    values = df.select(key, x, F.row_number().over(w.orderBy(F.md5(F.concat_ws("|", key, F.col(order).cast("string"), F.lit(str(seed)))))).alias("_i"))
    return places.join(values, [key, "_i"]).drop("_i")


def tail_forms(df: DataFrame, x: str, by: list[str], bins: int = 40) -> DataFrame:
    """R^2 of straight lines through the log density against x and against ln x: an exponential and a power tail.

    Values that are NaN lie in the last bin, and so do all values of a group that has one; a line through one bin, or through bins of equal counts, has R^2 NaN.
    """
    w = Window.partitionBy(*by)
    top = df.where(F.col(x) > 0).withColumn("_m", F.max(x).over(w))
    part = F.col(x) / F.col("_m") * bins
    hist = top.groupBy(*by, F.when(F.isnan(part), bins - 1).otherwise(F.least(F.floor(part), F.lit(bins - 1))).alias("b")).agg(F.count("*").alias("n"), F.first("_m").alias("_m"))
    mid = (F.col("b") + 0.5) / bins * F.col("_m")

    def r2(a: Column, b: Column) -> Column:
        return special.ratio(F.covar_pop(a, b) ** 2, F.var_pop(a) * F.var_pop(b))

    return hist.groupBy(*by).agg(r2(F.ln("n"), mid).alias("r2_exponential"), r2(F.ln("n"), F.ln(mid)).alias("r2_power"))


def bessel_profile(profile: DataFrame, by: list[str], price: str = "price", share: str = "share") -> DataFrame:
    """Fit share = c |J0(omega (price - p0))| per group: a grid over omega and p0, refined around the best; c in closed form."""
    from numpy.polynomial.legendre import leggauss

    nodes, weights = leggauss(64)
    angle = (nodes + 1) * math.pi / 2

    def j0(z: np.ndarray) -> np.ndarray:
        return (np.cos(z[..., None] * np.sin(angle)) * weights).sum(-1) / 2

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p, y = pdf[price].to_numpy(float), pdf[share].to_numpy(float)
        centre, width = (p * y).sum() / y.sum(), max(np.ptp(p), 1e-9)
        best = (np.inf, 0.0, 0.0, 0.0)
        lo_w, hi_w, lo_p, hi_p = 0.5 / width, 60 / width, centre - width / 4, centre + width / 4
        for _ in range(3):
            for omega in np.linspace(lo_w, hi_w, 25):
                for p0 in np.linspace(lo_p, hi_p, 9):
                    f = np.abs(j0(omega * (p - p0)))
                    c = (f * y).sum() / max((f * f).sum(), 1e-12)
                    sse = ((y - c * f) ** 2).sum()
                    best = min(best, (sse, omega, p0, c))
            dw, dp = (hi_w - lo_w) / 12, (hi_p - lo_p) / 4
            lo_w, hi_w, lo_p, hi_p = max(best[1] - dw, 1e-9), best[1] + dw, best[2] - dp, best[2] + dp
        return pd.DataFrame([[*pdf[by].iloc[0].tolist(), best[3], best[1], best[2], 1 - best[0] / max(((y - y.mean()) ** 2).sum(), 1e-12)]], columns=[*by, "c", "omega", "p0", "r2"])

    kinds = dict(profile.dtypes)
    return profile.groupBy(*by).applyInPandas(run, ", ".join([*(f"{b} {kinds[b]}" for b in by), "c double, omega double, p0 double, r2 double"]))


def hawkes_loglik(events: DataFrame, trials: DataFrame, small: bool = True) -> DataFrame:
    """Log likelihood of self-exciting processes with exponential kernels: symbol, trial, loglik, mass (the compensator at
    the end).

    events: symbol, t.  trials: symbol, trial, mu, nu, alpha, begin, end (of the symbol's events); broadcast if small.
    Time is cut into blocks, as for the intensity: a block's own part is a running sum, its carry-in the decayed sums of the 80 blocks before.
    So a task holds one block's events.  Trials share what they can: those of one alpha have the same sums, and the alphas of a symbol within a factor of
    150 the same blocks, in which their mean kernel decays by exp(-10), so events move once and not once per trial.
    """
    decay, reach, apart = 10.0, 80, 150.0
    of = Window.partitionBy("symbol")
    low, high = F.min("alpha").over(of), F.max("alpha").over(of)
    shared = trials.withColumn("mid", F.when(high <= low * apart, F.sqrt(low * high)).otherwise(F.col("alpha")))
    # whole numbers as keys: a double is made anew before it is hashed, so one shuffle would not serve all steps
    shared = shared.withColumn("cut", F.dense_rank().over(of.orderBy("mid")))
    shared = shared.withColumn("k", F.dense_rank().over(Window.partitionBy("symbol", "cut").orderBy("alpha")) - 1)
    kernels = range(shared.agg(F.max("k")).first()[0] + 1)
    # places beyond a cut's own alphas are null, and so are their sums
    cuts = shared.groupBy("symbol", "cut", "mid").agg(*[F.max(F.when(F.col("k") == k, F.col("alpha"))).alias(f"a{k}") for k in kernels])
    runs = shared.groupBy("symbol", "cut").agg(F.collect_list(F.struct("trial", "k", "mu", "nu", "alpha", "begin", "end")).alias("x"))
    wide = (lambda df: F.broadcast(df)) if small else (lambda df: df)
    width = decay / F.col("mid")
    keys = ["symbol", "cut"]
    rows = events.select("symbol", "t").join(wide(cuts.select(*keys, "mid")), "symbol").withColumn("_b", F.floor(F.col("t") / width)).drop("mid").repartition(*keys, "_b")
    rows = rows.join(wide(cuts), keys)
    since = F.col("t") - F.col("_b") * width
    rows = rows.withColumns({"_u": since, **{f"_w{k}": F.exp(F.col(f"a{k}") * since) for k in kernels}})
    near = Window.partitionBy(*keys, "_b").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    past = Window.partitionBy(*keys).orderBy("_b").rangeBetween(-reach, -1)
    sums = rows.groupBy(*keys, "_b", "mid", *[f"a{k}" for k in kernels]).agg(*[F.sum(f"_w{k}").alias(f"_s{k}") for k in kernels])
    sums = sums.withColumn("_l", F.collect_list(F.struct("_b", *[f"_s{k}" for k in kernels])).over(past))

    def carried(k: int) -> Column:
        return F.aggregate("_l", F.lit(0.0), lambda acc, x: acc + x[f"_s{k}"] * F.exp(F.col(f"a{k}") * width * (x["_b"] - F.col("_b"))))

    left_in = sums.select(*keys, "_b", *[carried(k).alias(f"_c{k}") for k in kernels])
    both = rows.withColumns({f"_n{k}": F.coalesce(F.sum(f"_w{k}").over(near), F.lit(0.0)) for k in kernels}).join(left_in, [*keys, "_b"])
    held = [(F.col(f"_n{k}") + F.col(f"_c{k}")) * F.exp(-F.col(f"a{k}") * F.col("_u")) for k in kernels]
    tried = both.select(*keys, "t", F.array(*held).alias("_h")).join(wide(runs), keys).select("symbol", "t", "_h", F.explode("x").alias("x")).select("symbol", "t", "_h", "x.*")
    rate = F.col("mu") + F.col("nu") * F.col("alpha") * F.get("_h", F.col("k"))
    left = 1 - F.exp(-F.col("alpha") * (F.col("end") - F.col("t")))
    keys = ["symbol", "trial"]
    made = tried.groupBy(*keys, "mu", "nu", "begin", "end").agg(F.sum(F.ln(rate)).alias("_ll"), F.sum(left).alias("_left"))
    mass = F.col("mu") * (F.col("end") - F.col("begin")) + F.col("nu") * F.col("_left")
    return made.select(*keys, (F.col("_ll") - mass).alias("loglik"), mass.alias("mass"))


def hawkes_fit(events: DataFrame, rounds: int = 40, small_symbols: int = 50_000) -> DataFrame:
    """mu, nu, alpha of a self-exciting process per symbol by maximum likelihood, and the mean compensator of its gaps.

    events: symbol, t.  Gradient-free search on logarithms, of all symbols together: each round is one job that tries a step
    to both sides of each parameter.  The driver holds seven numbers a symbol; fewer than ten events or none apart
    give nulls.  Residuals of a good fit have mean 1.
    """
    spark = events.sparkSession
    data = stash(events.select("symbol", F.col("t").cast("double").alias("t")), "hawkes")
    known = {r.symbol: r for r in data.groupBy("symbol").agg(F.count("*").alias("n"), F.min("t").alias("begin"), F.max("t").alias("end")).collect()}
    able = {k: r for k, r in known.items() if r.n >= 10 and r.end > r.begin}
    at = {k: np.log([r.n / (r.end - r.begin) / 2, 0.4, r.n / (r.end - r.begin)]) for k, r in able.items()}
    step = {k: np.full(3, 0.7) for k in able}
    moves = np.vstack([np.zeros(3), np.eye(3), -np.eye(3)])

    def tried(open_: list) -> dict:
        points = {(k, i): at[k] + m * step[k] for k in open_ for i, m in enumerate(moves)}
        trials = [(k, i, *map(float, np.exp(p)), able[k].begin, able[k].end) for (k, i), p in points.items() if math.exp(p[1]) < 0.999]
        frame = spark.createDataFrame(trials, "symbol string, trial int, mu double, nu double, alpha double, begin double, end double")
        got = hawkes_loglik(data, frame, len(able) <= small_symbols).collect()
        return {(r.symbol, r.trial): (r.loglik, r.mass, points[r.symbol, r.trial]) for r in got}

    for _ in range(rounds):
        open_ = [k for k in able if step[k].max() >= 1e-3]
        if not open_:
            break
        got = tried(open_)
        for k in open_:
            here = got[k, 0][0]
            gains = [max(((got[k, s][0] - here, s) for s in (i + 1, i + 4) if (k, s) in got), default=(0.0, 0)) for i in range(3)]
            best = max(gains)
            for i, (gain, _) in enumerate(gains):
                step[k][i] *= 0.5 if gain <= 0 else 1.3 if gain == best[0] else 1.0
            if best[0] > 0:
                at[k] = got[k, best[1]][2]
    last = tried(list(able)) if able else {}
    out = [(k, r.n, *map(float, np.exp(at[k])), last[k, 0][0], last[k, 0][1] / r.n) if k in able else (k, r.n, None, None, None, None, None) for k, r in known.items()]
    return spark.createDataFrame(out, "symbol string, n long, mu double, nu double, alpha double, loglik double, residual double")


def pnl_regression(df: DataFrame, features: list[str], target: str, rounds: int = 60, step: float = 0.05, slope: float = 10.0, floor: float = 1e-3, ridge: float = 1e-3) -> tuple[list[float], list[float]]:
    """Weights that maximise the P&L of a smoothed sign of the signal, bets normalised; and the loss per round.

    Each round's gradient is one aggregation over all rows; the driver takes an Adam step on the weights alone.
    """
    w, m, v, losses = np.full(len(features), 0.1), np.zeros(len(features)), np.zeros(len(features)), []
    data = stash(df.select(*features, target), "pnl")
    for k in range(1, rounds + 1):
        s = sum((F.lit(float(x)) * F.col(c) for x, c in zip(w, features, strict=True)), F.lit(0.0))
        g, h = F.tanh(slope * s / 2), F.sqrt(s * s + floor)
        dg = slope / 2 * (1 - g * g)
        y = F.col(target)
        row = data.agg(F.sum(y * h * g).alias("a"), F.sum(h).alias("b"), *[F.sum(y * (dg * h + g * s / h) * F.col(c)).alias(f"da{i}") for i, c in enumerate(features)], *[F.sum(s / h * F.col(c)).alias(f"db{i}") for i, c in enumerate(features)]).first()
        grad = np.array([-(row[f"da{i}"] * row.b - row.a * row[f"db{i}"]) / row.b**2 for i in range(len(features))]) + ridge * w / np.sqrt(w * w + floor)
        losses.append(-row.a / row.b + ridge * float(np.sqrt(w * w + floor).sum()))
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w = w - step * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return w.tolist(), losses


def matrix_spectrum(entries: DataFrame, value: str, most: int = 1000) -> dict[str, np.ndarray]:
    """Singular values, left and right vectors (columns) and their overlaps of a square matrix (i, j, value); up to `most` names, checked."""
    names = sorted(r[0] for r in entries.select("i").union(entries.select("j")).distinct().limit(most + 1).collect())
    if len(names) > most:
        raise ValueError(f"more than {most} names")
    at = {n: k for k, n in enumerate(names)}
    a = np.zeros((len(names), len(names)))
    for r in entries.select("i", "j", value).collect():
        a[at[r.i], at[r.j]] = r[value] or 0.0
    u, s, vt = np.linalg.svd(a)
    return {"singular": s, "left": u, "right": vt.T, "overlap": np.abs(u.T @ vt.T)}


def kalman_level(df: DataFrame, x: str, process: float, noise: float, key: str = "symbol", order: str = "bar_idx") -> DataFrame:
    """Local level filter: adds level and gain.

    The gain hangs on the row number only and settles, so it is a short list of numbers; the level is then a mean of
    past values whose weights fall geometrically, and rows that weigh less than 1e-16 are left out.  A row needs a bounded
    frame, and no task a whole series.  process and noise must be above 0, else the gain never settles.
    """
    if process <= 0 or noise <= 0:
        raise ValueError("process and noise must be above 0")
    gains, var = [1.0], noise
    while len(gains) < 10_000:
        var += process
        gains.append(var / (var + noise))
        var *= 1 - gains[-1]
        if abs(gains[-1] - gains[-2]) < 1e-15:
            break
    frame = 2 + math.ceil(math.log(1e-16) / math.log(1 - min(gains))) + len(gains) if min(gains) < 1 else 2
    w = Window.partitionBy(key).orderBy(order)
    table = F.array(*map(F.lit, gains))
    rows = df.select(key, order, x).withColumn("gain", F.get(table, F.least(F.row_number().over(w), F.lit(len(gains))) - 1))
    past = rows.withColumn("_p", F.collect_list(F.struct(F.col(x).cast("double").alias("x"), "gain")).over(w.rowsBetween(-frame, 0)))
    level = F.aggregate("_p", F.get("_p", F.lit(0))["x"], lambda acc, v: acc + v["gain"] * (v["x"] - acc))
    return past.select(key, order, x, level.alias("level"), "gain")


def dtw_distances(df: DataFrame, x: str, pairs: DataFrame, key: str = "symbol", order: str = "bar_idx", band: int = 20) -> DataFrame:
    """Dynamic time warping distance within a band for given pairs (i, j) of series, each z-scored."""
    z = df.withColumn("_z", F.try_divide(F.col(x) - F.avg(x).over(Window.partitionBy(key)), F.stddev_pop(x).over(Window.partitionBy(key))))
    arr = z.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, "_z"))), lambda r: r["_z"]).alias("v"))
    both = pairs.join(arr.select(F.col(key).alias("i"), F.col("v").alias("a")), "i").join(arr.select(F.col(key).alias("j"), F.col("v").alias("b")), "j")

    @F.pandas_udf("double")
    def distance(a: pd.Series, b: pd.Series) -> pd.Series:
        def one(p: np.ndarray, q: np.ndarray) -> float:
            """The cells of one diagonal (k + c = s) depend on the two before it only, so a diagonal within the band is one step."""
            n, m = len(p), len(q)
            wide = max(band, abs(n - m))
            before, last, new = (np.full(n + 2, np.inf) for _ in range(3))
            before[0] = 0.0
            for s in range(2, n + m + 1):
                low, high = max(1, s - m, -((wide - s) // 2)), min(n, s - 1, (s + wide) // 2)
                new[max(low - 1, 0)] = new[min(high + 1, n + 1)] = np.inf
                k = np.arange(low, high + 1)
                new[k] = np.abs(p[k - 1] - q[s - k - 1]) + np.minimum(np.minimum(last[k - 1], last[k]), before[k - 1])
                before, last, new = last, new, before
            return float(last[n]) if n + m > 1 else float(np.inf)

        return pd.Series([one(p, q) for p, q in zip(a, b, strict=True)])

    return both.select("i", "j", distance("a", "b").alias("dtw"))


def volatility_clusters(df: DataFrame, features: list[str], k: int = 3, seed: int = 1) -> DataFrame:
    """Adds cluster by k-means with distributed initialisation."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    vectors = VectorAssembler(inputCols=features, outputCol="_v", handleInvalid="skip").transform(df)
    return KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="cluster", initMode="k-means||").fit(vectors).transform(vectors).drop("_v")


def percentile_signal(folds: DataFrame, score: str, low: float = 0.4, high: float = 0.6, key: str = "symbol") -> DataFrame:
    """In each fold's test part: 1 above the training scores' high percentile, -1 below the low one, else 0."""
    cuts = folds.where("part = 'train'").groupBy(key, "fold").agg(F.percentile(score, [low, high]).alias("_c"))
    rows = folds.where("part = 'test'").join(cuts, [key, "fold"])
    return rows.withColumn("signal", F.when(F.col(score) > F.col("_c")[1], 1).when(F.col(score) < F.col("_c")[0], -1).otherwise(0)).drop("_c")


def trading_account(df: DataFrame, action: str, price: str = "close", turbulence: str | None = None, limit: float = 90.1, cash: float = 1e6, fee: float = 0.003, key: str = "symbol", order: str = "bar_idx") -> DataFrame:
    """Account of an agent's actions (shares to buy or sell): cash never negative, everything sold above the turbulence limit."""
    kinds = dict(df.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        money, held, out = cash, 0.0, []
        for a, p, wild in zip(pdf[action].tolist(), pdf[price].tolist(), pdf["_wild"].tolist(), strict=True):
            a = -held if wild else a
            a = max(a, -held) if a < 0 else min(a, money / (p * (1 + fee)))
            money = money - a * p - abs(a) * p * fee
            held += a
            out.append((money, held, money + held * p))
        got = np.array(out).reshape(-1, 3)
        return pd.DataFrame({key: pdf[key], order: pdf[order], "cash": got[:, 0], "held": got[:, 1], "value": got[:, 2]})

    # told here and not in pandas, where NaN, which is over any limit, looks like null
    wild = F.coalesce(F.col(turbulence) > limit, F.lit(False)) if turbulence else F.lit(False)
    return df.select(key, order, action, price, wild.alias("_wild")).groupBy(key).applyInPandas(run, f"{key} {kinds[key]}, {order} {kinds[order]}, cash double, held double, value double")


def rolling_normality(df: DataFrame, x: str, rows: int, cdf: Callable[[Column], Column], key: str = "symbol", order: str = "bar_idx") -> DataFrame:
    """KS distance of the last `rows` values, standardised, to a normal law: one bounded array per row."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(-rows + 1, 0)
    held = df.withColumns({"_v": F.array_sort(F.collect_list(x).over(w)), "_m": F.avg(x).over(w), "_s": F.stddev_pop(x).over(w)}).where((F.size("_v") == rows) & (F.col("_s") > 0))
    gaps = F.transform("_v", lambda v, i: F.greatest(F.abs((i + 1) / rows - cdf((v - F.col("_m")) / F.col("_s"))), F.abs(i / rows - cdf((v - F.col("_m")) / F.col("_s")))))
    return held.withColumn("ks", F.array_max(gaps)).drop("_v", "_m", "_s")


def range_then_test(tr: DataFrame, st: DataFrame, within: int) -> DataFrame:
    """Secondary tests that a valid range, known before them, leads up to: the latest such range within so many bars."""
    size = within + 1
    a = tr.where("valid").select("symbol", F.col("pivot_seq").alias("tr"), F.col("known").alias("tr_known"))
    a = a.withColumn("_b", F.explode(F.array(F.floor(F.col("tr_known") / size), F.floor(F.col("tr_known") / size) + 1)))
    b = st.where("valid").select("symbol", F.col("pivot_seq").alias("st"), F.col("known").alias("st_known")).withColumn("_b", F.floor(F.col("st_known") / size))
    met = a.join(b, ["symbol", "_b"]).where((F.col("tr_known") < F.col("st_known")) & (F.col("st_known") - F.col("tr_known") <= within))
    return met.groupBy("symbol", "st", "st_known").agg(F.max(F.struct("tr_known", "tr")).alias("_t")).select("symbol", "st", "st_known", "_t.tr", "_t.tr_known")


def forward_after(windows: DataFrame, bars: DataFrame, horizon: int) -> DataFrame:
    """Mean log return over the horizon after valid windows become known, beside that of all bars; returns across zero are NaN and count."""
    w = Window.partitionBy("symbol").orderBy("bar_idx")
    later = bars.select("symbol", "bar_idx", "close", F.lead("close", horizon).over(w).alias("_later"))
    ahead = later.select("symbol", "bar_idx", special.log_ratio(F.col("_later"), F.col("close")).alias("fwd")).where("fwd is not null")
    hit = windows.where("valid").select("symbol", F.col("known").alias("bar_idx")).distinct().withColumn("hit", F.lit(True))
    rows = ahead.join(hit, ["symbol", "bar_idx"], "left")
    return rows.groupBy("symbol").agg(F.avg(F.when(F.col("hit"), F.col("fwd"))).alias("after"), F.avg("fwd").alias("always"), F.count("hit").alias("n"))
