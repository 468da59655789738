"""Generalised linear models of many groups at once by iteratively reweighted least squares.

A round is one grouped aggregate of the normal equations, as many sums per group as features squared, and a small solve per group
where its sums lie.  Rows never gather in a task, coefficients never on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stash

#: Linear predictors stay within these bounds, so that separable data stop growing.
BOUND = 30.0
FEW_GROUPS = 50_000


def _working(eta: Column, y: Column, family: str) -> tuple[Column, Column, Column]:
    """Weight, working response and deviance (up to the data's own part) of a row."""
    if family == "logit":
        p = 1 / (1 + F.exp(-eta))
        w = F.greatest(p * (1 - p), F.lit(1e-10))
        return w, eta + (y - p) / w, -2 * (y * F.ln(p) + (1 - y) * F.ln(1 - p))
    if family == "gamma":
        mu = F.exp(eta)
        return F.lit(1.0), eta + (y - mu) / mu, 2 * (y / mu - 1 - F.ln(y / mu))
    if family == "hinge":
        short = y * eta < 1
        return short.cast("double"), y, F.when(short, F.pow(1 - y * eta, 2)).otherwise(0.0)
    raise ValueError(f"no family {family}")


def irls(rows: DataFrame, by: list[str], features: list[Column], y: Column, family: str, rounds: int = 25, tolerance: float = 1e-9, ridge: float = 1e-9, penalty: float = 0.0) -> DataFrame:
    """Per group of by: coef (array, one per feature), n, deviance, pearson (sum of squared relative residuals; gamma).

    family: logit (y is 0 or 1), gamma with a log link (y above 0), or hinge (y is -1 or 1): the support vector machine of squared
    hinge losses, whose rounds are regressions on the rows inside the margin.  penalty times the squared coefficients is added to the loss.  Rows with a null feature or y are left out; a group
    without full rank leans on the ridge.  Rounds end when no coefficient moves by more than tolerance.
    """
    k = len(features)
    data = rows.select(*by, *[f.cast("double").alias(f"_x{i}") for i, f in enumerate(features)], y.cast("double").alias("_y")).na.drop(subset=[*[f"_x{i}" for i in range(k)], "_y"])
    data = stash(data, "irls")
    start = F.array(F.lit(0.0), *[F.lit(0.0)] * (k - 1))
    coef = stash(data.groupBy(*by).agg(F.avg("_y").alias("_m"), F.count("*").alias("n")).select(*by, start.alias("coef"), "n", "_m"), "coef")
    small = coef.limit(FEW_GROUPS + 1).count() <= FEW_GROUPS
    kinds = dict(data.dtypes)
    out = ", ".join([*(f"{b} {kinds[b]}" for b in by), "coef array<double>", "n long", "moved double"])
    pairs = [(i, j) for i in range(k) for j in range(i, k)]

    def solve(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            made, moved = [], []
            for r in pdf.itertuples():
                gram = np.zeros((k, k))
                for (i, j), v in zip(pairs, r.gram, strict=True):
                    gram[i, j] = gram[j, i] = v
                new = np.linalg.solve(gram + (penalty + ridge * max(gram.trace() / k, 1.0)) * np.eye(k), np.array(r.right))
                moved.append(float(np.abs(new - np.array(r.coef)).max()))
                made.append(new.tolist())
            yield pdf[by].assign(coef=made, n=pdf["n"].to_numpy(), moved=moved)

    def met(coef: DataFrame) -> DataFrame:
        side = coef.select(*by, "coef", "n", *(["_m"] if "_m" in coef.columns else []))
        side = F.broadcast(side) if small else side
        return data.join(side, by) if by else data.crossJoin(side)  # without keys one row of coefficients

    def predictor(first: bool) -> Column:
        if first and family == "gamma":
            return F.ln("_m")
        eta = sum((F.col("coef")[i] * F.col(f"_x{i}") for i in range(k)), F.lit(0.0))
        return F.greatest(F.least(eta, F.lit(BOUND)), F.lit(-BOUND))

    for turn in range(rounds):
        w, z, _ = _working(predictor(turn == 0), F.col("_y"), family)
        weighted = met(coef).withColumns({"_w": w, "_z": z})
        sums = weighted.groupBy(*by, "coef", "n").agg(
            F.array(*[F.sum(F.col("_w") * F.col(f"_x{i}") * F.col(f"_x{j}")) for i, j in pairs]).alias("gram"),
            F.array(*[F.sum(F.col("_w") * F.col(f"_x{i}") * F.col("_z")) for i in range(k)]).alias("right"),
        )
        coef = stash(sums.mapInPandas(solve, out), "coef")
        if (coef.agg(F.max("moved")).first()[0] or 0.0) <= tolerance:
            break
    eta = predictor(False)
    _, _, deviance = _working(eta, F.col("_y"), family)
    pearson = F.pow(F.col("_y") / F.exp(eta) - 1, 2)
    return met(coef).groupBy(*by, "coef", "n").agg(F.sum(deviance).alias("deviance"), F.sum(pearson).alias("pearson"))


def zero_adjusted_gamma(rows: DataFrame, by: list[str], features: list[Column], y: Column, rounds: int = 25) -> DataFrame:
    """Per group: nu_coef (log odds of a zero), mu_coef (log mean above zero), sigma2, n: a point mass at zero and a gamma law beside it."""
    zero = irls(rows, by, features, (y <= 0).cast("int"), "logit", rounds).select(*by, F.col("coef").alias("nu_coef"), "n")
    above = irls(rows.where(y > 0), by, features, y, "gamma", rounds)
    free = F.greatest(F.col("n") - len(features), F.lit(1))
    positive = above.select(*by, F.col("coef").alias("mu_coef"), (F.col("pearson") / free).alias("sigma2"))
    return zero.join(positive, by) if by else zero.crossJoin(positive)


def zaga_moments(nu_eta: Column, mu_eta: Column, sigma2: Column) -> tuple[Column, Column]:
    """Mean and variance of the law from its predictors: E = (1 - nu) mu, Var = (1 - nu) mu^2 (sigma^2 + nu)."""
    nu, mu = 1 / (1 + F.exp(-nu_eta)), F.exp(mu_eta)
    return (1 - nu) * mu, (1 - nu) * mu * mu * (sigma2 + nu)


def redrawn(rows: DataFrame, model: DataFrame, features: list[Column], replicas: int, seed: int = 1) -> DataFrame:
    """rows once per replica, y drawn anew from a fitted law (one row: nu_coef, mu_coef, sigma2): the parametric bootstrap's tables.

    A draw depends on seed, row number `row` and replica only, not on where it is made.
    """
    wide = rows.crossJoin(F.broadcast(model.select("nu_coef", "mu_coef", "sigma2")))
    eta = lambda c: sum((F.col(c)[i] * f for i, f in enumerate(features)), F.lit(0.0))
    wide = wide.select(*rows.columns, eta("nu_coef").alias("_nu"), eta("mu_coef").alias("_mu"), "sigma2").withColumn("replica", F.explode(F.sequence(F.lit(0), F.lit(replicas - 1))))
    kinds, names = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields), [*rows.columns, "replica"]

    def draw(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            y = np.zeros(len(pdf))
            for i, (row, replica, nu, mu, s2) in enumerate(zip(pdf.row, pdf.replica, pdf._nu, pdf._mu, pdf.sigma2, strict=True)):
                rng = np.random.default_rng([seed, int(row), int(replica)])
                if rng.random() >= 1 / (1 + np.exp(-nu)):
                    y[i] = rng.gamma(1 / s2, np.exp(mu) * s2)
            yield pdf[names].assign(drawn=y)

    return wide.mapInPandas(draw, f"{kinds}, replica int, drawn double")


def pagerank(edges: DataFrame, nodes: DataFrame, rounds: int = 20, damping: float = 0.85) -> DataFrame:
    """(v, rank) of each node after a fixed number of rounds: edges (i, j) pass ranks on, nodes without edges out give to all alike.

    nodes: v.  A round is a join on the edges' source, summed by target, and is written: a plan of k rounds would name
    the first ranks 3 ** k times.  Edges are dealt out by source
    once and stay there, so a round moves ranks and partial sums only.
    """
    sides = stash(edges.select("i", "j").distinct(), "edges")
    out = sides.groupBy("i").agg(F.count("*").alias("n_out"))
    nodes = stash(nodes.select("v").distinct().join(out.select(F.col("i").alias("v"), "n_out"), "v", "left"), "nodes")
    sides = sides.repartition(1 + sides.count() // 250_000, "i").persist()
    n = nodes.count()
    rank = nodes.select("v", "n_out", F.lit(1.0 / max(n, 1)).alias("rank"))
    for _ in range(rounds):
        given = rank.join(sides, F.col("v") == F.col("i")).groupBy(F.col("j").alias("to")).agg(F.sum(F.col("rank") / F.col("n_out")).alias("got"))
        lost = rank.agg(F.sum(F.when(F.col("n_out").isNull(), F.col("rank")).otherwise(0.0)).alias("lost"))  # one number
        new = rank.select("v", "n_out").join(given, F.col("v") == F.col("to"), "left").crossJoin(F.broadcast(lost))
        rank = new.select("v", "n_out", ((1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / n)).alias("rank"))
        rank = stash(rank, "rank")
    sides.unpersist()
    return rank.select("v", "rank")


def least_squares(rows: DataFrame, by: list[str], features: list[Column], y: Column, ridge: float = 1e-12) -> DataFrame:
    """Per group of by: coef (array) and n of an ordinary regression: one grouped aggregate of products and a small solve per group."""
    k = len(features)
    data = rows.select(*by, *[f.cast("double").alias(f"_x{i}") for i, f in enumerate(features)], y.cast("double").alias("_y")).na.drop(subset=[*[f"_x{i}" for i in range(k)], "_y"])
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    sums = data.groupBy(*by).agg(F.count("*").alias("n"), F.array(*[F.sum(F.col(f"_x{i}") * F.col(f"_x{j}")) for i, j in pairs]).alias("gram"), F.array(*[F.sum(F.col(f"_x{i}") * F.col("_y")) for i in range(k)]).alias("right"))
    kinds = dict(data.dtypes)

    def solve(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            made = []
            for r in pdf.itertuples():
                gram = np.zeros((k, k))
                for (i, j), v in zip(pairs, r.gram, strict=True):
                    gram[i, j] = gram[j, i] = v
                made.append(np.linalg.solve(gram + ridge * np.eye(k) * max(gram.trace() / k, 1e-12), np.array(r.right)).tolist())
            yield pdf[by].assign(coef=made, n=pdf["n"].to_numpy())

    return sums.mapInPandas(solve, ", ".join([*(f"{b} {kinds[b]}" for b in by), "coef array<double>", "n long"]))


def hannan_rissanen(df: DataFrame, x: str, p: int = 1, q: int = 1, long: int = 6, key: str = "symbol", order: str = "bar_idx") -> tuple[DataFrame, DataFrame]:
    """An ARMA model per key in two regressions: (key, coef, n) with constant, p lags and q lagged shocks; and df with `forecast` of x
    from the rows before, null where they do not reach.

    The first regression, on so many lags, gives the shocks; the second regresses on lags and lagged shocks.  Lags look a fixed number of rows
    back; both fits are grouped aggregates.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(order)
    lags = df.withColumns({f"_l{i}": F.lag(x, i).over(w) for i in range(1, long + 1)})
    first = least_squares(lags, [key], [F.lit(1.0), *[F.col(f"_l{i}") for i in range(1, long + 1)]], F.col(x)).select(F.col(key).alias("_key"), F.col("coef").alias("_c"))
    fitted = lags.join(first, F.col(key).eqNullSafe(F.col("_key")), "left")
    shock = F.col(x) - F.col("_c")[0] - sum((F.col("_c")[i] * F.col(f"_l{i}") for i in range(1, long + 1)), F.lit(0.0))
    known = fitted.withColumn("_e", shock).drop("_key", "_c")
    known = stash(known.withColumns({f"_e{i}": F.lag("_e", i).over(w) for i in range(1, q + 1)}), "shocks")
    features = [F.lit(1.0), *[F.col(f"_l{i}") for i in range(1, p + 1)], *[F.col(f"_e{i}") for i in range(1, q + 1)]]
    coef = stash(least_squares(known, [key], features, F.col(x)), "arma")
    met = known.join(coef.select(F.col(key).alias("_key"), "coef"), F.col(key).eqNullSafe(F.col("_key")), "left")
    made = met.withColumn("forecast", sum((F.col("coef")[i] * f for i, f in enumerate(features)), F.lit(0.0)))
    return coef, made.select(*df.columns, "forecast")
