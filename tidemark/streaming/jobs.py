"""Streaming forms of the batch operators: bars with watermarks, latest klines, swings and order admission with state."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import astuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.signals import Limits, place
from ..operators.swings import PIVOTS, Leg, ZigZag


def event_stream(spark: SparkSession, folder: str, schema, pattern: str = "events.parquet") -> DataFrame:  # noqa: ANN001
    """The events table replayed as a file stream of trades-like rows; ts is a timestamp, so it can have a watermark."""
    raw = spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)
    return raw.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), F.col("value").alias("price"), F.get_json_object("props", "$.k").cast("long").alias("volume"))


def stream_bars(ticks: DataFrame, width: str, late: str = "10 minutes") -> DataFrame:
    """OHLCV per symbol and window; rows later than the watermark are left out."""
    at = F.struct("ts", "seq")
    grouped = ticks.withWatermark("ts", late).groupBy("symbol", F.window("ts", width)).agg(F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("volume").alias("volume"))
    return grouped.select("symbol", F.col("window.start").alias("ts"), "open", "high", "low", "close", "volume")


def stream_sessions(ticks: DataFrame, gap: str, late: str = "10 minutes") -> DataFrame:
    """Trades and volume of each session of a symbol, ended by a gap without trades."""
    grouped = ticks.withWatermark("ts", late).groupBy("symbol", F.session_window("ts", gap)).agg(F.count("*").alias("n"), F.sum("volume").alias("volume"))
    return grouped.select("symbol", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n", "volume")


def latest_klines(updates: DataFrame, late: str = "1 hour") -> DataFrame:
    """A kline is sent again while its bar forms; the last update of each (symbol, open_time) stays.

    updates: symbol, open_time (timestamp), event_time, close, volume.
    """
    return updates.withWatermark("open_time", late).groupBy("symbol", "open_time").agg(F.max_by(F.struct("close", "volume"), "event_time").alias("k"), F.max("event_time").alias("event_time")).select("symbol", "open_time", "event_time", "k.close", "k.volume")


def in_order(batches: Iterator[pd.DataFrame], order: str, columns: list[str], size: int = 65_536) -> Iterator[tuple]:
    """The rows of a key by order, as (whether it is the last chunk, lists of the columns) for each chunk of `size` rows.

    Batches come in no order, so a micro-batch of a key is held: as packed numbers (8 bytes a value), never as objects.
    """
    parts: dict[str, list] = {c: [] for c in dict.fromkeys([order, *columns])}
    for pdf in batches:
        for c, held in parts.items():
            held.append(pdf[c].to_numpy(copy=True))
    whole = {}
    for c in list(parts):
        whole[c] = np.concatenate(parts.pop(c))
    by = np.argsort(whole[order], kind="stable")
    for k in range(0, len(by), size):
        at = by[k : k + size]
        yield k + size >= len(by), [whole[c][at].tolist() for c in columns]


def _zigzag(pct: float) -> Callable:
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        bar, legs, n = state.get if state.exists else (0, [], 0)
        chain = ZigZag(pct, bar, [Leg(*leg) for leg in legs])
        for last, (highs, lows) in in_order(batches, "bar_idx", ["high", "low"]):
            found = []
            for high, low in zip(highs, lows, strict=True):
                if p := chain.push(high, low):
                    found.append((key[0], n, *p))
                    n += 1
            if last:
                state.update((chain.bar, [astuple(leg) for leg in chain.legs], n))
            yield pd.DataFrame(found, columns=["symbol", "pivot_seq", "bar_idx", "price", "kind", "confirm_idx"])

    return run


def stream_zigzag(bars: DataFrame, pct: float = 0.015) -> DataFrame:
    """Pivots as they are confirmed; bars (symbol, bar_idx, high, low) come in order per symbol.  The state is the leg or
    legs under way."""
    return bars.groupBy("symbol").applyInPandasWithState(_zigzag(pct), PIVOTS, "bar long, legs array<struct<side:int,far_at:long,far:double,back_at:long,back:double>>, n long", "append", GroupStateTimeout.NoTimeout)


def _admission(limits: Limits) -> Callable:
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        book = {side: (last, list(prices)) for side, last, prices in (state.get[0] if state.exists else [])}
        for end, (at, price, direction) in in_order(batches, "bar_idx", ["bar_idx", "price", "direction"]):
            verdict = [place(book, limits, *r) for r in zip(at, price, direction, strict=True)]
            if end:
                state.update(([(side, last, prices) for side, (last, prices) in book.items()],))
            yield pd.DataFrame({"symbol": key[0], "bar_idx": at, "price": price, "direction": direction, "verdict": verdict})

    return run


def stream_admission(signals: DataFrame, bars: int = 15, share: float = 1e-4, orders: int = 13) -> DataFrame:
    """Verdicts on a stream of signals (symbol, bar_idx, price, direction); the state is the book of open orders."""
    schema = "symbol string, bar_idx long, price double, direction int, verdict string"
    return signals.groupBy("symbol").applyInPandasWithState(_admission(Limits(bars, share, None, orders)), schema, "book array<struct<side:int,last:long,prices:array<double>>>", "append", GroupStateTimeout.NoTimeout)


class StreamHandle:
    """A running query that can be stopped with a time limit."""

    def __init__(self, query: StreamingQuery) -> None:
        self.query = query

    def stop(self, timeout: float = 5.0) -> bool:
        """Stop and wait; whether the query has ended in time."""
        self.query.stop()
        return bool(self.query.awaitTermination(timeout))


def start(df: DataFrame, on_rows: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamHandle:
    """Hand each micro-batch to a callback; the checkpoint makes a restart go on where it stopped."""
    return StreamHandle(df.writeStream.outputMode(mode).foreachBatch(on_rows).option("checkpointLocation", checkpoint).start())


def to_memory(df: DataFrame, name: str, mode: str = "append") -> StreamHandle:
    """Rows into an in-memory table, for tests and notebooks."""
    return StreamHandle(df.writeStream.outputMode(mode).format("memory").queryName(name).start())
