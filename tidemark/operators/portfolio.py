"""Portfolio simulation from signals, sizing, and the daily long-only protocol."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FIELDS = "symbol string, ts timestamp, cash double, position double, equity double, fees double"


def simulate(signals: DataFrame, init: float = 30_000.0, fee: float = 0.0008, parts: int = 13, take_profit: float | None = None) -> DataFrame:
    """Cash, position, equity and fees paid of each symbol after each bar.

    entries buy and short_entries sell for init / parts at the close; positions add up; a bar with exits closes a long, one
    with short_exits a short position.  A buy that cash cannot pay is made as large as it can be.  With take_profit the whole
    basket closes on the bar on which equity stands that share of init above where it stood before the basket's first
    order; there is no stop loss.  An ordered fold of one symbol's bars.
    """
    import pandas as pd

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        cash, pos, fees, out = init, 0.0, 0.0, []
        lot, before = init / parts, init  # before: equity when the basket was last empty
        pdf = pdf.sort_values("ts")
        for ts, p, buy, leave, short, cover in pdf[["ts", "close", "entries", "exits", "short_entries", "short_exits"]].itertuples(index=False):
            size = 0.0
            if leave and pos > 0 or cover and pos < 0 or take_profit is not None and pos and cash + pos * p - before >= take_profit * init:
                size -= pos
            if buy:
                size += min(lot, max(cash, 0.0) / (1 + fee)) / p
            if short:
                size -= lot / p
            if size:
                cost = abs(size) * p * fee
                cash, pos, fees = cash - size * p - cost, pos + size, fees + cost
            if not pos:
                before = cash
            out.append((key[0], ts, cash, pos, cash + pos * p, fees))
        return pd.DataFrame(out, columns=["symbol", "ts", "cash", "position", "equity", "fees"])

    cols = ["symbol", "ts", "close", "entries", "exits", "short_entries", "short_exits"]
    return signals.select(*[F.col(c).cast("timestamp") if c == "ts" else F.col(c) for c in cols]).groupBy("symbol").applyInPandas(run, FIELDS)


def equity_report(equity: DataFrame, init: float) -> DataFrame:
    """ROI in percent and maximum drawdown of each symbol's equity."""
    w = Window.partitionBy("symbol").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    dd = equity.withColumn("_dd", 1 - F.col("equity") / F.greatest(F.max("equity").over(w), F.lit(init)))
    return dd.groupBy("symbol").agg(((F.max_by("equity", "ts") - init) / init * 100).alias("roi"), F.max("_dd").alias("max_drawdown"), F.max("fees").alias("fees"))


def value_at_risk(mu: Column, sigma: Column, z: float = 1.6448536269514722) -> dict[str, Column]:
    """Loss quantiles of a long and a short position; z is the normal quantile."""
    return {"var_long": mu - z * sigma, "var_short": mu + z * sigma}


def alternating_trades(df: DataFrame, buy: Column, sell: Column, by: list[str] | None = None, ts: str = "ts") -> DataFrame:
    """Long-only alternation: a buy counts only when flat, a sell only when long.

    Repeated buys before a sell and repeated sells collapse: of marked rows those are kept whose predecessor is of the
    other kind, which needs one window and no fold.
    """
    by = by or ["symbol"]
    marked = df.withColumn("act", F.when(buy, 1).when(sell, -1)).where("act is not null")
    w = Window.partitionBy(*by).orderBy(ts)
    return marked.withColumn("before", F.coalesce(F.lag("act").over(w), F.lit(-1))).where("act <> before").drop("before")


def round_trips(trades: DataFrame, price: str = "close", by: list[str] | None = None, ts: str = "ts", lot: int = 100) -> DataFrame:
    """Buys paired with the next sell: entry, exit, return; quantities are whole lots by construction of the return."""
    by = by or ["symbol"]
    w = Window.partitionBy(*by).orderBy(ts)
    ahead = trades.withColumns({"exit_ts": F.lead(ts).over(w), "exit": F.lead(price).over(w)}).where("act = 1 and exit is not null")
    return ahead.select(*by, F.col(ts).alias("entry_ts"), F.col(price).alias("entry"), "exit_ts", "exit", (F.col("exit") / F.col(price) - 1).alias("ret"), F.lit(lot).alias("lot"))
