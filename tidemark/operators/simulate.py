"""Simulated paths: one row per path and step, each path from its own seed, so any task can make it again.

Paths are dealt over tasks by id; a task holds one path at a time.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

PATHS = "path long, step int, value double"


def _paths(spark: SparkSession, n: int, make: Callable[[np.random.Generator], np.ndarray], seed: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in batch.id.tolist():
                v = make(np.random.default_rng([seed, i]))
                yield pd.DataFrame({"path": i, "step": np.arange(len(v), dtype=np.int32), "value": v})

    return spark.range(n).mapInPandas(run, PATHS)


def gbm(spark: SparkSession, n: int, steps: int, mu: float, sigma: float, dt: float = 1 / 252, s0: float = 100.0, seed: int = 1) -> DataFrame:
    """Geometric Brownian motion."""
    return _paths(spark, n, lambda g: s0 * np.exp(np.cumsum(np.r_[0, (mu - sigma**2 / 2) * dt + sigma * math.sqrt(dt) * g.normal(size=steps)])), seed)


def merton(spark: SparkSession, n: int, steps: int, mu: float, sigma: float, rate: float, jump_mean: float, jump_sd: float, dt: float = 1 / 252, s0: float = 100.0, seed: int = 1) -> DataFrame:
    """Jump diffusion: GBM with a Poisson number of normal jumps per step, drift compensated."""
    drift = mu - sigma**2 / 2 - rate * (math.exp(jump_mean + jump_sd**2 / 2) - 1)

    def make(g: np.random.Generator) -> np.ndarray:
        k = g.poisson(rate * dt, steps)
        return s0 * np.exp(np.cumsum(np.r_[0, drift * dt + sigma * math.sqrt(dt) * g.normal(size=steps) + k * jump_mean + np.sqrt(k) * jump_sd * g.normal(size=steps)]))

    return _paths(spark, n, make, seed)


def garch(spark: SparkSession, n: int, steps: int, omega: float, alpha: float, beta: float, s0: float = 100.0, seed: int = 1) -> DataFrame:
    """Prices whose log returns follow GARCH(1,1), started at the stationary variance."""
    def make(g: np.random.Generator) -> np.ndarray:
        z, v, out = g.normal(size=steps), omega / (1 - alpha - beta), [0.0]
        for x in z:
            r = math.sqrt(v) * x
            out.append(r)
            v = omega + alpha * r * r + beta * v
        return s0 * np.exp(np.cumsum(out))

    return _paths(spark, n, make, seed)


def variance_gamma(spark: SparkSession, n: int, steps: int, mu: float, sigma: float, theta: float, nu: float, dt: float = 1 / 252, s0: float = 100.0, seed: int = 1) -> DataFrame:
    """Brownian motion with drift theta in gamma time of variance rate nu."""
    def make(g: np.random.Generator) -> np.ndarray:
        t = g.gamma(dt / nu, nu, steps)
        return s0 * np.exp(np.cumsum(np.r_[0, mu * dt + theta * t + sigma * np.sqrt(t) * g.normal(size=steps)]))

    return _paths(spark, n, make, seed)


def ornstein_uhlenbeck(spark: SparkSession, n: int, steps: int, theta: float, mean: float, sigma: float, dt: float = 1 / 252, x0: float = 0.0, seed: int = 1) -> DataFrame:
    """Mean reversion by its exact one-step law."""
    def make(g: np.random.Generator) -> np.ndarray:
        a = math.exp(-theta * dt)
        sd, out = sigma * math.sqrt((1 - a * a) / (2 * theta)), [x0]
        for z in g.normal(size=steps):
            out.append(mean + (out[-1] - mean) * a + sd * z)
        return np.array(out)

    return _paths(spark, n, make, seed)


def herding(spark: SparkSession, xis: list[float], steps: int, traders: int, gamma: float, noise: float = 0.01, dt: float = 0.1, volume: float = 1.0, seed: int = 1) -> DataFrame:
    """Sentiment of interacting traders for each coupling xi: xi, step, sentiment, ret, volume.

    kappa is xi times a news shock; the sentiment drifts to tanh(kappa x) and diffuses less the more the traders agree;
    returns are fundamental noise plus gamma times its change, volume grows with |sentiment|.
    """
    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            for i, xi in zip(pdf.i.tolist(), pdf.xi.tolist(), strict=True):
                g = np.random.default_rng([seed, i])
                x, rows = 0.0, []
                for k in range(steps):
                    kappa = xi * (1 + g.normal() * math.sqrt(dt))
                    t = math.tanh(kappa * x)
                    new = min(1.0, max(-1.0, x + (t - x) * dt + math.sqrt(max(0.0, 2 / traders * (1 - x * t)) * dt) * g.normal()))
                    rows.append((xi, k, new, noise * math.sqrt(dt) * g.normal() + gamma * (new - x), volume * traders * (abs(new) + 1) / 2))
                    x = new
                yield pd.DataFrame(rows, columns=["xi", "step", "sentiment", "ret", "volume"])

    base = spark.createDataFrame(list(enumerate(map(float, xis))), "i long, xi double")
    return base.repartition(max(1, len(xis))).mapInPandas(run, "xi double, step int, sentiment double, ret double, volume double")


def hawkes_thinning(spark: SparkSession, n: int, horizon: float, mu: float, nu: float, alpha: float, seed: int = 1) -> DataFrame:
    """Event times of n self-exciting processes with exponential kernels (nu < 1), by thinning: path, step, value (time)."""
    if nu >= 1:
        raise ValueError("nu must be below 1, or the process explodes")

    def make(g: np.random.Generator) -> np.ndarray:
        t, held, out = 0.0, 0.0, []
        while True:
            top = mu + nu * alpha * held
            wait = g.exponential(1 / top)
            t, held = t + wait, held * math.exp(-alpha * wait)
            if t > horizon:
                return np.array(out)
            if g.random() * top <= mu + nu * alpha * held:
                out.append(t)
                held += 1.0

    return _paths(spark, n, make, seed)


def swarm(fitness: Callable[[DataFrame], DataFrame], spark: SparkSession, low: list[float], high: list[float], size: int = 100, generations: int = 20, cuts: tuple[float, float, float] = (0.5, 0.6, 0.7), seed: int = 1) -> tuple[list[float], float]:
    """Simplified swarm search for the largest fitness.

    fitness takes the population (id, x array) and returns (id, y): the costly part runs as one Spark job per
    generation.  Each coordinate becomes the global best's, the own best's, stays, or is drawn anew, by `cuts`.
    """
    g, lo, hi = np.random.default_rng(seed), np.array(low), np.array(high)
    x = lo + g.random((size, len(lo))) * (hi - lo)
    best_x, best_y = x.copy(), np.full(size, -np.inf)
    for _ in range(generations):
        rows = fitness(spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "id long, x array<double>")).collect()
        y = np.full(size, -np.inf)
        for r in rows:
            y[r.id] = r.y
        better = y > best_y
        best_x[better], best_y[better] = x[better], y[better]
        top = best_x[best_y.argmax()]
        draw = g.random(x.shape)
        x = np.where(draw < cuts[0], top, np.where(draw < cuts[1], best_x, np.where(draw < cuts[2], x, lo + g.random(x.shape) * (hi - lo))))
    return best_x[best_y.argmax()].tolist(), float(best_y.max())


def swarms(fitness: Callable[[DataFrame], DataFrame], spark: SparkSession, keys: list[str], low: list[float], high: list[float], size: int = 100, generations: int = 20, runs: int = 10, digits: int = 3, cuts: tuple[float, float, float] = (0.5, 0.6, 0.7), seed: int = 1) -> dict[str, tuple[list[float], float]]:
    """swarm() for each key, the best of so many runs; coordinates are rounded to digits.

    fitness takes the population (key, id, x array) and returns (id, y).  The populations of all keys and runs are one Spark
    job per generation, in which a point that a key has had before is not computed again.
    """
    g, lo, hi = np.random.default_rng(seed), np.array(low), np.array(high)
    shape = (len(keys), runs, size, len(lo))
    x = lo + g.random(shape) * (hi - lo)
    best_x, best_y, known = x.copy(), np.full(shape[:3], -np.inf), {}
    for _ in range(generations):
        points = [(keys[k], tuple(v)) for k, own in enumerate(np.round(x, digits)) for v in own.reshape(-1, len(lo)).tolist()]
        if new := sorted(set(points) - set(known)):
            known |= dict.fromkeys(new, -np.inf)
            for r in fitness(spark.createDataFrame([(k, i, [*v]) for i, (k, v) in enumerate(new)], "key string, id long, x array<double>")).collect():
                if r.y is not None:
                    known[new[r.id]] = r.y
        y = np.array([known[p] for p in points]).reshape(shape[:3])
        better = y > best_y
        best_x[better], best_y[better] = x[better], y[better]
        top = np.take_along_axis(best_x, best_y.argmax(2)[:, :, None, None], 2)
        draw = g.random(shape)
        x = np.where(draw < cuts[0], top, np.where(draw < cuts[1], best_x, np.where(draw < cuts[2], x, lo + g.random(shape) * (hi - lo))))
    flat_x, flat_y = best_x.reshape(len(keys), -1, len(lo)), best_y.reshape(len(keys), -1)
    return {key: (np.round(flat_x[k, i], digits).tolist(), float(flat_y[k, i])) for k, key in enumerate(keys) for i in [flat_y[k].argmax()]}
