"""Laws fitted by likelihood for many groups at once: each round is one grouped aggregate, and one small step per group."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import special
from .shared import stash

FEW_GROUPS = 50_000
#: Step of the differences, in units of the scale, its logarithm and that of the shape.
STEP = 1e-3
PLACES = [(0, 0, 0), *[tuple(s * int(i == k) for i in range(3)) for k in range(3) for s in (1, -1)], (1, 1, 0), (1, 0, 1), (0, 1, 1)]
#: Bounds of the shape: beyond the upper one the law is normal to four digits.
SHAPES = (0.2, 200.0)


def _loglik(spread: float, n: int, scale: float, shape: float) -> float:
    return n * (math.lgamma((shape + 1) / 2) - math.lgamma(shape / 2) - 0.5 * math.log(shape * math.pi) - math.log(scale)) - (shape + 1) / 2 * spread


def _newton(values: list[float]) -> np.ndarray:
    """The step to the top of the parabola through the log likelihoods at PLACES, damped until it climbs, at most 1 long."""
    f = dict(zip(PLACES, values, strict=True))
    unit = np.eye(3, dtype=int)
    up, down = [f[tuple(e)] for e in unit], [f[tuple(-e)] for e in unit]
    grad = (np.array(up) - np.array(down)) / (2 * STEP)
    curve = np.diag([(u - 2 * f[0, 0, 0] + d) / STEP**2 for u, d in zip(up, down, strict=True)])
    for i, j in ((0, 1), (0, 2), (1, 2)):
        curve[i, j] = curve[j, i] = (f[tuple(unit[i] + unit[j])] - up[i] - up[j] + f[0, 0, 0]) / STEP**2
    values_, axes = np.linalg.eigh(-curve)
    step = axes @ ((axes.T @ grad) / np.maximum(np.abs(values_), 1e-6 * max(np.abs(values_).max(), 1e-300)))
    return step / max(1.0, float(np.abs(step).max()))


def t_law(df: DataFrame, x: str, by: list[str], rounds: int = 40, tolerance: float = 1e-6) -> DataFrame:
    """Location-scale t law of x in each group by maximum likelihood: by, mu, sigma, beta (the shape), loglik, n.

    Newton steps on (mu, ln sigma, ln beta): a round sums the spread ln(1 + z^2 / beta) at ten near points, from which gradient and curvature follow; a step that does
    not climb is tried again at a quarter.  Nulls and values that are no finite number, which no such law gives, are left out; a group of fewer than three rows, or whose quartiles are equal and whose values do not vary, has nulls.
    """
    data = stash(df.select(*by, F.col(x).cast("double").alias("_x")).where(special.finite(F.col("_x"))), "law")
    q = F.percentile_approx("_x", [0.25, 0.5, 0.75], 1000)
    first = data.groupBy(*by).agg(F.count("*").alias("n"), q.alias("q"), F.stddev_pop("_x").alias("s"))
    scale = F.when(F.col("q")[2] > F.col("q")[0], (F.col("q")[2] - F.col("q")[0]) / 1.48).otherwise(F.col("s"))
    start = F.when((F.col("n") >= 3) & (scale > 0), F.array(F.col("q")[1], F.ln(scale), F.lit(math.log(4.0))))
    none = F.lit(None)
    state = stash(first.select(*by, "n", start.alias("at"), none.cast("array<double>").alias("best"), none.cast("double").alias("loglik"), none.cast("array<double>").alias("move"), start.isNull().alias("done")), "law")
    small = state.limit(FEW_GROUPS + 1).count() <= FEW_GROUPS
    kinds = state.schema
    low, high = (math.log(s) for s in SHAPES)

    def place(p: tuple) -> Column:
        m, ls, lb = (F.col("at")[k] for k in range(3))
        z = (F.col("_x") - m - p[0] * STEP * F.exp(ls)) / F.exp(ls + p[1] * STEP)
        return F.sum(F.log1p(z * z / F.exp(lb + p[2] * STEP)))

    def climb(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = pdf.copy()
            for i, r in enumerate(pdf.to_dict("records")):
                if r["done"]:
                    continue
                at = np.array(r["at"])
                logs = [_loglik(s, r["n"], math.exp(at[1] + p[1] * STEP), math.exp(at[2] + p[2] * STEP)) for s, p in zip(r["sums"], PLACES, strict=True)]
                if r["best"] is None or logs[0] >= r["loglik"]:
                    best, top, move = at, logs[0], _newton(logs)
                else:
                    best, top, move = np.array(r["best"]), r["loglik"], np.array(r["move"]) / 4
                new = best + move * np.array([math.exp(best[1]), 1, 1])
                new[2] = min(max(new[2], low), high)
                stays = bool(np.abs((new - best) / np.array([math.exp(best[1]), 1, 1])).max() < tolerance)
                for c, v in (("at", new.tolist()), ("best", best.tolist()), ("loglik", float(top)), ("move", move.tolist()), ("done", stays)):
                    out.iat[i, out.columns.get_loc(c)] = v
            yield out.drop(columns="sums")

    ended = state.where("done")
    state = state.where("not done")
    for _ in range(rounds):
        if state.isEmpty():
            break
        side = F.broadcast(state.select(*by, "at")) if small else state.select(*by, "at")
        met = data.join(side, by) if by else data.crossJoin(side)  # without keys one row of parameters
        sums = met.groupBy(*by).agg(F.array(*[place(p) for p in PLACES]).alias("sums"))
        state = stash((state.join(sums, by) if by else state.crossJoin(sums)).mapInPandas(climb, kinds), "law")
        ended, state = ended.unionByName(state.where("done")), state.where("not done")
    last = ended.unionByName(state)
    return last.select(*by, F.col("best")[0].alias("mu"), F.exp(F.col("best")[1]).alias("sigma"), F.exp(F.col("best")[2]).alias("beta"), "loglik", "n")
