"""Signals: trend classification, order admission, accuracy, the regression net and the composite strategy."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

VERDICTS = ("admitted", "time", "price", "cap")


def classify(pred: Column, close: Column, before: Column, delta: Column) -> dict[str, Column]:
    """Trend of a forecast: d1 and d2 are the first and second difference it makes; 1 if d1 > delta and d2 > 0,
    -1 if d1 < -delta and d2 < 0, else 0.  All are taken to nine digits, so that a forecast on the threshold is none."""
    d1, d2, delta = F.round(pred - close, 9), F.round(pred - 2 * close + before, 9), F.round(delta, 9)
    return {"d1": d1, "d2": d2, "signal": F.when((d1 > delta) & (d2 > 0), 1).when((d1 < -delta) & (d2 < 0), -1).otherwise(0)}


def trend_signals(bars: DataFrame, pred: str, delta_frac: Column | float) -> DataFrame:
    """Signals per bar from a forecast column of the next close; the threshold is a share of the close.

    A symbol's first and last bars have no signal and drop; move is what the close did next.
    """
    w = Window.partitionBy("symbol").orderBy("ts")
    rows = bars.withColumns({"before": F.lag("close").over(w), "next_close": F.lead("close").over(w)}).where("before is not null and next_close is not null")
    made = classify(F.col(pred), F.col("close"), F.col("before"), (delta_frac if isinstance(delta_frac, Column) else F.lit(delta_frac)) * F.col("close"))
    return rows.withColumns(made | {"move": F.col("next_close") - F.col("close")})


def signal_report(signals: DataFrame, by: list[str]) -> DataFrame:
    """Counts of long, short and none, coverage, and accuracy over the non-zero signals (null without any)."""
    hit = (F.signum("move") == F.col("signal")).cast("double")
    return signals.groupBy(*by).agg(
        F.count_if(F.col("signal") == 1).alias("n_long"), F.count_if(F.col("signal") == -1).alias("n_short"), F.count_if(F.col("signal") == 0).alias("n_none"),
        F.avg((F.col("signal") != 0).cast("double")).alias("coverage"), F.avg(F.when(F.col("signal") != 0, hit)).alias("accuracy"),
    )


def forecast_report(df: DataFrame, pred: str, by: list[str]) -> DataFrame:
    """RMSE of the forecast and of persistence, and directional accuracy where the close moved; needs next_close."""
    err, naive = F.col(pred) - F.col("next_close"), F.col("close") - F.col("next_close")
    right = (F.signum(F.col(pred) - F.col("close")) == F.signum(F.col("move"))).cast("double")
    return df.groupBy(*by).agg(F.sqrt(F.avg(err * err)).alias("rmse"), F.sqrt(F.avg(naive * naive)).alias("rmse_naive"), F.avg(F.when(F.col("move") != 0, right)).alias("directional"))


@dataclass(frozen=True)
class Limits:
    """What an order must keep from the open ones: `bars` from the last of its direction, and a price distance from all of
    its direction, as a share of its own price or as an amount (exactly one of both).  `orders` caps the open orders
    of both directions; it is odd, so that a hedged book cannot fill it evenly."""

    bars: int = 15
    share: float | None = None
    amount: float | None = None
    orders: int = 13

    def __post_init__(self) -> None:
        if (self.share is None) == (self.amount is None):
            raise ValueError("give exactly one of share and amount")
        if self.orders % 2 == 0:
            raise ValueError("orders must be odd")


#: Open orders of one direction: the last one's bar and all prices in rising order.  A book has one such side for each direction.
Side = tuple[int, list[float]]


def place(book: dict[int, Side], limits: Limits, bar: int, price: float, direction: int) -> str:
    """Verdict on an order; an admitted one enters the book.  Orders come in order of their bars, so the last order of a
    direction decides on the time, and the two prices around the new one on the price."""
    last, prices = book.get(direction, (None, []))
    apart = limits.amount if limits.share is None else limits.share * price
    at = bisect_left(prices, price)
    verdict = "admitted"
    if any(abs(p - price) <= apart for p in prices[max(at - 1, 0) : at + 1]):
        verdict = "price"
    if last is not None and bar - last <= limits.bars:
        verdict = "time"
    if sum(len(p) for _, p in book.values()) >= limits.orders:
        verdict = "cap"
    if verdict == "admitted":
        book[direction] = (bar, [*prices[:at], price, *prices[at:]])
    return verdict


def admit(signals: DataFrame, bars: int = 15, share: float = 1e-4, orders: int = 13) -> DataFrame:
    """A verdict for each non-zero signal in order of bar_idx: symbol, bar_idx, price, direction, verdict.

    An ordered fold over one symbol's signals, which one task holds; its state is the book.
    """
    limits = Limits(bars, share, None, orders)
    import pandas as pd

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, book = pdf.sort_values("bar_idx"), {}
        pdf["verdict"] = [place(book, limits, *r) for r in zip(pdf.bar_idx.tolist(), pdf.price.tolist(), pdf.direction.tolist(), strict=True)]
        return pdf

    rows = signals.where("signal <> 0").select("symbol", "bar_idx", F.col("close").alias("price"), F.col("signal").cast("int").alias("direction"))
    return rows.groupBy("symbol").applyInPandas(run, "symbol string, bar_idx long, price double, direction int, verdict string")


def verdict_histogram(verdicts: DataFrame) -> DataFrame:
    """symbol, verdict, n with zeros for verdicts that did not occur."""
    counts = verdicts.groupBy("symbol").agg(*[F.count_if(F.col("verdict") == v).alias(v) for v in VERDICTS])
    return counts.unpivot("symbol", list(VERDICTS), "verdict", "n")


def scaled_conjugate(objective: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, rounds: int = 200, tol: float = 1e-8) -> tuple[np.ndarray, list[float]]:
    """Minimum of an objective (value and slope) by scaled conjugate gradients, and the values on the way.

    Along a direction the objective is taken as a parabola: its bend is measured by a short probe and a damping added,
    so that it opens upwards.  What the step gains, over what the parabola promised, says whether to move and how the
    damping goes on.  Fixed values of the method: probe 1e-4, first damping 1e-6, trust limits 0.25 and 0.75, factor 0.25.
    """
    probe, damping = 1e-4, 1e-6
    point, (value, slope) = start, objective(start)
    values, heading, bend, since = [value], -slope, None, 0
    for _ in range(rounds):
        length = float(heading @ heading)
        if length <= tol * tol or float(np.abs(slope).max()) < tol:
            break
        if bend is None:
            short = probe / length**0.5
            bend = float(heading @ (objective(point + short * heading)[1] - slope)) / (short * length)
        if bend + damping <= 0:
            damping = -2 * bend
        curve, fall = (bend + damping) * length, -float(heading @ slope)
        ahead = point + fall / curve * heading
        there, slope_there = objective(ahead)
        kept = 2 * curve * (value - there) / (fall * fall)
        if kept >= 0:
            since += 1
            turn = 0.0 if since % len(point) == 0 else float(slope_there @ (slope_there - slope)) / fall
            point, value, slope, heading, bend = ahead, there, slope_there, turn * heading - slope_there, None
            values.append(value)
        if kept >= 0.75:
            damping *= 0.25
        if kept < 0.25:
            damping += curve * (1 - kept) / length
    return point, values


class TanhLayer:
    """One hidden tanh layer and a linear output.  Weights are one vector: a row of inputs and bias for each hidden unit,
    then the output's weights and bias."""

    def __init__(self, inputs: int, hidden: int) -> None:
        self.inputs, self.hidden = inputs, hidden

    def start(self, seed: int) -> np.ndarray:
        rng = np.random.default_rng(seed)
        units = np.column_stack([rng.normal(0, self.inputs**-0.5, (self.hidden, self.inputs)), np.zeros(self.hidden)])
        return np.append(units.ravel(), [*rng.normal(0, self.hidden**-0.5, self.hidden), 0.0])

    def active(self, w: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Inputs and hidden units with a column of ones, and the output."""
        ones = np.ones((len(x), 1))
        seen = np.hstack([x, ones])
        cut = self.hidden * (self.inputs + 1)
        units = np.hstack([np.tanh(seen @ w[:cut].reshape(self.hidden, -1).T), ones])
        return seen, units, units @ w[cut:]

    def objective(self, x: np.ndarray, y: np.ndarray) -> Callable[[np.ndarray], tuple[float, np.ndarray]]:
        """Half the mean squared error and its slope, as a function of the weights."""

        def of(w: np.ndarray) -> tuple[float, np.ndarray]:
            seen, units, out = self.active(w, x)
            miss = out - y
            inner = units[:, :-1]
            pull = (miss / len(y))[:, None] * w[-self.hidden - 1 : -1] * (1 - inner * inner)
            return float(miss @ miss) / (2 * len(y)), np.append((pull.T @ seen).ravel(), units.T @ miss / len(y))

        return of


def net_forecast(features: DataFrame, cols: list[str], n_hidden: int = 32, max_iter: int = 60, seed: int = 0) -> DataFrame:
    """Train one net per symbol on all its training rows and forecast y for its other rows.

    features: symbol, ts, is_train, cols, y; scaled by training moments.  One task holds one symbol's rows.
    """
    import pandas as pd

    net = TanhLayer(len(cols), n_hidden)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts")
        train, rest = pdf[pdf.is_train], pdf[~pdf.is_train]
        mx, sx = train[cols].mean().to_numpy(), train[cols].std(ddof=0).replace(0, 1).to_numpy()
        my, sy = train.y.mean(), train.y.std(ddof=0) or 1.0
        w, _ = scaled_conjugate(net.objective((train[cols].to_numpy() - mx) / sx, ((train.y - my) / sy).to_numpy()), net.start(seed), max_iter)
        return rest[["symbol", "ts"]].assign(pred=net.active(w, (rest[cols].to_numpy() - mx) / sx)[2] * sy + my)

    return features.groupBy("symbol").applyInPandas(run, f"symbol string, ts {features.schema['ts'].dataType.simpleString()}, pred double")


def composite(bars: DataFrame, n_train: int, feature_cols: list[str] | None = None, delta_frac: float = 0.0, bars_apart: int = 15, share: float = 1e-4, orders: int = 13, forecast: Callable[..., DataFrame] = net_forecast) -> DataFrame:
    """Forecast, classify, admit: bars with signal, verdict and the booleans entries and short_entries.  Exits are false: portfolio.simulate() can close a basket at a profit."""
    from .bars import split_by_time, supervised

    cols = feature_cols or ["open", "high", "low", "close", "volume"]
    data = split_by_time(supervised(bars, cols), n_train)
    pred = forecast(data, [f"x_{c}" for c in cols])
    # the forecast of a bar's close belongs to the bar before
    w = Window.partitionBy("symbol").orderBy("ts")
    known = bars.join(pred, ["symbol", "ts"], "left").withColumn("pred_next", F.lead("pred").over(w))
    signals = trend_signals(known.where("pred_next is not null"), "pred_next", delta_frac)
    verdicts = admit(signals, bars_apart, share, orders)
    joined = signals.join(verdicts.select("symbol", "bar_idx", "verdict"), ["symbol", "bar_idx"], "left")
    taken = F.coalesce(F.col("verdict") == "admitted", F.lit(False))
    return joined.select("symbol", "ts", "bar_idx", "close", "signal", "d1", "d2", "verdict", (taken & (F.col("signal") == 1)).alias("entries"), F.lit(False).alias("exits"), (taken & (F.col("signal") == -1)).alias("short_entries"), F.lit(False).alias("short_exits"))
