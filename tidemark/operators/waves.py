"""Volume profiles as waves around equilibrium prices: one centre, two centres, two widths, and the random day's profile."""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import combinations

import numpy as np
import pandas as pd
from numpy.polynomial.legendre import leggauss
from pyspark.sql import DataFrame

NODES, WEIGHTS = leggauss(64)
ANGLE = (NODES + 1) * math.pi / 2
#: Widths (omega, or A of the random day) are sought between these numbers over the range of prices.
NARROW, WIDE = 60.0, 0.5


def j0(z: np.ndarray) -> np.ndarray:
    return (np.cos(z[..., None] * np.sin(ANGLE)) * WEIGHTS).sum(-1) / 2


def one_centre(p: np.ndarray, w: float, a: float) -> np.ndarray:
    return np.abs(j0(w * (p - a)))


def two_centres(p: np.ndarray, w: float, a: float, b: float) -> np.ndarray:
    return one_centre(p, w, a) + one_centre(p, w, b)


def two_widths(p: np.ndarray, w: float, v: float, a: float, b: float) -> np.ndarray:
    return one_centre(p, w, a) + one_centre(p, v, b)


def random_day(p: np.ndarray, w: float, a: float) -> np.ndarray:
    """The first eigenfunction at constant energy, exp(-x) * |F(-1, 1, 2x)| with x = w * |p - a|."""
    x = w * np.abs(p - a)
    return np.exp(-x) * np.abs(1 - 2 * x)


#: Shape and how many of its leading parameters are widths, in the order in which they are tried.
SHAPES: dict[str, tuple[Callable, int]] = {"one_centre": (one_centre, 1), "two_centres": (two_centres, 1), "two_widths": (two_widths, 2), "random_day": (random_day, 1)}


def critical_r2(n: int, k: int, level: float = 0.95) -> float:
    """R^2 that k parameters reach on n cells of noise with that probability: the quantile of a beta law, found through its angle."""
    if n - k - 1 < 1:
        return math.nan
    angle = np.linspace(0, math.pi / 2, 20_001)
    density = np.sin(angle) ** (k - 1) * np.cos(angle) ** (n - k - 2)
    mass = np.concatenate([[0], np.cumsum((density[1:] + density[:-1]) / 2)])
    return float(np.sin(np.interp(level, mass / mass[-1], angle)) ** 2)


def _fit(shape: Callable, widths: int, p: np.ndarray, y: np.ndarray, starts: list[tuple], tries: int = 6) -> tuple[float, float, tuple]:
    """Least squares by Levenberg-Marquardt from the best of the starts; p is scaled to a range of 1.  Returns squared error, factor and parameters.

    The factor is linear and eliminated; widths move in logarithms, within their bounds.
    """

    def at(t: np.ndarray) -> tuple:
        return (*np.exp(np.clip(t[:widths], math.log(WIDE), math.log(NARROW))), *t[widths:])

    def left(t: np.ndarray) -> tuple[np.ndarray, float]:
        f = shape(p, *at(t))
        c = float((f * y).sum() / max((f * f).sum(), 1e-300))
        return y - c * f, c

    def improve(t: np.ndarray) -> tuple[float, np.ndarray]:
        r, damp = left(t)[0], 1e-2
        for _ in range(60):
            slope = np.column_stack([(left(t + e)[0] - r) / 1e-6 for e in np.eye(len(t)) * 1e-6])
            gram, right = slope.T @ slope, -slope.T @ r
            step = np.linalg.lstsq(gram + damp * np.diag(np.maximum(np.diag(gram), 1e-12)), right, rcond=None)[0]
            new = left(t + step)[0]
            if new @ new < r @ r:
                done = r @ r - new @ new < 1e-12 * (r @ r)
                t, r, damp = t + step, new, max(damp / 5, 1e-9)
                if done:
                    break
            elif (damp := damp * 4) > 1e8:
                break
        return float(r @ r), t

    logs = [np.array([*np.log(s[:widths]), *s[widths:]]) for s in starts]
    near = sorted(logs, key=lambda t: float((left(t)[0] ** 2).sum()))[:tries]
    error, best = min((improve(t) for t in near), key=lambda v: v[0])
    return error, left(best)[1], at(best)


def _centres(p: np.ndarray, y: np.ndarray, most: int = 6) -> list[float]:
    """The heaviest cells that lie a twentieth of the range apart, and the mean."""
    out: list[float] = []
    for k in np.argsort(-y, kind="stable"):
        if all(abs(p[k] - a) >= 0.05 for a in out):
            out.append(float(p[k]))
        if len(out) == most:
            break
    return [*out, float((p * y).sum() / y.sum())]


def _starts(model: str, x: np.ndarray, y: np.ndarray, found: tuple) -> list[tuple]:
    """Where the search of a shape begins, with widths near enough that the waves at the far end fall in step; two widths begin at the two centres found before."""
    widths, centres = np.linspace(1, 58, 39), _centres(x, y)
    if model == "two_widths":
        return [(found[0] * a, found[0] * b, *found[1:]) for a in (0.25, 0.5, 1.0, 2.0, 4.0) for b in (0.25, 0.5, 1.0, 2.0, 4.0)]
    if model == "two_centres":
        return [(w, *pair) for w in widths for pair in combinations(centres, 2)]
    return [(w, a) for w in widths for a in (*centres, 0.25, 0.5, 0.75)]


def fit_profile(price: np.ndarray, share: np.ndarray) -> dict:
    """The first shape whose fit is significant at 95 %, else the one-centre fit with passed false.

    model, passed, cells, c, omega, omega2 (two widths), p0, p02 (two centres), r2 and its critical value.  Prices all equal, no volume, or too few cells for a test do not pass.
    """
    order = np.argsort(price, kind="stable")
    p, y = price[order], share[order]
    low, span, total = float(p.min()), float(np.ptp(p)), float(((y - y.mean()) ** 2).sum())
    none = {"model": "none", "passed": False, "cells": len(p), **dict.fromkeys(("c", "omega", "omega2", "p0", "p02", "r2", "critical"))}
    if span <= 0 or y.sum() <= 0 or total <= 0:
        return none
    x = (p - low) / span
    first, found = none, ()
    for model, (shape, n) in SHAPES.items():
        error, c, found = _fit(shape, n, x, y, _starts(model, x, y, found))
        k = 1 + len(found)
        fit = {"model": model, "cells": len(p), "c": c, "omega": found[0] / span, "omega2": found[1] / span if n == 2 else None, "p0": low + span * found[n], "p02": low + span * found[n + 1] if len(found) > n + 1 else None, "r2": 1 - error / total, "critical": critical_r2(len(p), k)}
        fit["passed"] = bool(fit["r2"] > fit["critical"])
        first = first if first is not none else fit
        if fit["passed"]:
            return fit
    return first


def wave_profiles(profile: DataFrame, by: list[str], price: str = "price", share: str = "share") -> DataFrame:
    """fit_profile() of each group's volume profile.  A task holds one group's cells, as many as it has different prices; round prices to ticks before."""
    kinds = dict(profile.dtypes)
    columns = {"model": "string", "passed": "boolean", "cells": "long", "c": "double", "omega": "double", "omega2": "double", "p0": "double", "p02": "double", "r2": "double", "critical": "double"}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        fit = fit_profile(pdf[price].to_numpy(float), pdf[share].fillna(0).to_numpy(float))
        return pd.DataFrame([[*pdf[by].iloc[0].tolist(), *(fit[c] for c in columns)]], columns=[*by, *columns])

    known = profile.where(f"`{price}` is not null").select(*by, price, share)
    return known.groupBy(*by).applyInPandas(run, ", ".join([*(f"`{b}` {kinds[b]}" for b in by), *(f"{c} {t}" for c, t in columns.items())]))
