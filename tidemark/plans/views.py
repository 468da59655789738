"""Market views over the driver's tables, and the same views in DuckDB SQL.

`events` becomes a tape of trades per event type: an integer-cent random walk, so prices are
exact in both engines.  (symbol, ts, seq) is the total order of every time-series operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.bars import resample
from ..operators.scan import day_of, running_sum


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, ts, seq, volume, participant, side, price."""
    step = F.expr("CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END * (CAST(round(value * 100) AS BIGINT) DIV 50)")
    moves = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"),
        F.get_json_object("props", "$.k").cast("long").alias("volume"), (F.col("user_id") % 5).alias("participant"),
        F.when(F.col("event_id") % 2 == 0, "buy").otherwise("sell").alias("side"), step.alias("step"),
    )
    walked = running_sum(moves, ["symbol"], ["ts", "seq"], F.col("step"), day_of("ts"), "walk")
    return walked.select("symbol", "ts", "seq", "volume", "participant", "side", ((F.lit(100000) + F.col("walk")) / F.lit(100.0)).alias("price"))


def bars(spark: SparkSession, sf_dir: str, width: str = "4 hours") -> DataFrame:
    """OHLCV bars of the trades with bar_idx from 0 per symbol."""
    return number_bars(resample(trades(spark, sf_dir), width))


def number_bars(df: DataFrame) -> DataFrame:
    return df.withColumn("bar_idx", (F.row_number().over(Window.partitionBy("symbol").orderBy("ts")) - 1).cast("long"))


TRADES = """trades AS (
SELECT event_type AS symbol, ts, event_id AS seq, CAST(json_extract_string(props, '$.k') AS BIGINT) AS volume, user_id % 5 AS participant,
  CASE WHEN event_id % 2 = 0 THEN 'buy' ELSE 'sell' END AS side,
  (100000 + SUM(CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END * (CAST(ROUND(value * 100) AS BIGINT) // 50))
    OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) / 100.0::DOUBLE AS price
FROM events)"""

BARS = TRADES + """, raw_bars AS (
SELECT symbol, time_bucket(INTERVAL '4 hours', ts) AS ts, arg_min(price, (ts, seq)) AS open, max(price) AS high, min(price) AS low,
  arg_max(price, (ts, seq)) AS close, sum(volume)::DOUBLE AS volume FROM trades GROUP BY 1, 2),
bars AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS bar_idx FROM raw_bars)"""
