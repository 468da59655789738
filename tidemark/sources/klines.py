"""Kline archives: enumeration, zipped and plain CSV, cleaning, and the loader that dispatches by sector."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from datetime import date

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The columns of a raw kline file, which has no header, in order.
RAW = ["open_time", "open", "high", "low", "close", "volume", "close_time", "quote_volume", "trades", "taker_base_vol", "taker_quote_vol", "ignore"]
RAW_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in RAW])
BAR_SCHEMA = "symbol string, ts timestamp, open double, high double, low double, close double, volume double"


def epoch(t: Column) -> Column:
    """Milliseconds or microseconds since 1970, told apart by size, as a timestamp."""
    return F.when(t > 100_000_000_000_000, F.timestamp_micros(t)).otherwise(F.timestamp_millis(t))


def clean(raw: DataFrame, symbol: Column | None = None) -> DataFrame:
    """Raw klines as bars; rows whose open_time is no number (headers) drop, other bad numbers are null."""
    t = F.expr("try_cast(open_time AS BIGINT)")
    sym = symbol if symbol is not None else F.col("symbol")
    return raw.where(t.isNotNull()).select(sym.alias("symbol"), epoch(t).alias("ts"), *[F.expr(f"try_cast({c} AS DOUBLE)").alias(c) for c in ("open", "high", "low", "close", "volume")])


def archive_files(symbols: DataFrame, interval: str, start: date, end: date, today: date) -> DataFrame:
    """Files that hold [start, end] of each symbol: a monthly file for each complete month, daily ones for the current month up to yesterday."""
    base = symbols.select("symbol", *[F.lit(v).alias(n) for n, v in (("interval", interval), ("start", start), ("end", end), ("today", today))])
    last = F.least("end", F.date_sub("today", 1))
    month = F.trunc("today", "MM")
    whole = F.expr("CASE WHEN trunc(start, 'MM') <= add_months(trunc(today, 'MM'), -1) AND start <= end THEN sequence(trunc(start, 'MM'), least(trunc(end, 'MM'), add_months(trunc(today, 'MM'), -1)), INTERVAL 1 MONTH) END")
    days = F.when(F.greatest("start", month) <= last, F.sequence(F.greatest("start", month), last))
    monthly = base.select("symbol", "interval", F.explode(whole).alias("d")).select("symbol", "interval", F.lit("monthly").alias("period"), F.date_format("d", "yyyy-MM").alias("stamp"))
    daily = base.select("symbol", "interval", F.explode(days).alias("d")).select("symbol", "interval", F.lit("daily").alias("period"), F.date_format("d", "yyyy-MM-dd").alias("stamp"))
    return monthly.unionByName(daily).withColumn("file", F.concat_ws("/", "period", "symbol", "interval", F.concat(F.concat_ws("-", "symbol", "interval", "stamp"), F.lit(".zip"))))


def _unzip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, content in zip(batch.path, batch.content, strict=True):
            with zipfile.ZipFile(io.BytesIO(content)) as archive, archive.open(archive.namelist()[0]) as member:
                for part in pd.read_csv(member, names=RAW, dtype=str, chunksize=100_000, keep_default_na=False):
                    yield part.assign(path=path)


def read_archive(spark: SparkSession, folder: str, symbol: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Bars of the zipped files under folder (first member of each); missing files are simply not there.

    Files are read where the executors are, a chunk of rows at a time; [start, end] is inclusive.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"{symbol}-*.zip").option("recursiveFileLookup", "true").load(folder).select("path", "content")
    raw = files.mapInPandas(_unzip, ", ".join(f"{c} string" for c in [*RAW, "path"]))
    return between(clean(raw, F.lit(symbol)), start, end)


def between(bars: DataFrame, start: str | None, end: str | None) -> DataFrame:
    """Rows with start <= ts <= end; null means open."""
    if start is not None:
        bars = bars.where(F.col("ts") >= F.lit(start).cast("timestamp"))
    return bars if end is None else bars.where(F.col("ts") <= F.lit(end).cast("timestamp"))


def read_csv(spark: SparkSession, path: str, symbol: str) -> DataFrame:
    """Bars from a CSV file with the header Open Time, Open, Low, High, Close (any case; Volume optional)."""
    raw = spark.read.option("header", True).csv(path)
    raw = raw.toDF(*[c.strip().lower().replace(" ", "_") for c in raw.columns])
    t = F.col("open_time")
    stamp = F.coalesce(epoch(F.expr("try_cast(open_time AS BIGINT)")), F.try_to_timestamp(t))
    volume = F.expr("try_cast(volume AS DOUBLE)") if "volume" in raw.columns else F.lit(None).cast("double")
    return raw.select(F.lit(symbol).alias("symbol"), stamp.alias("ts"), *[F.expr(f"try_cast({c} AS DOUBLE)").alias(c) for c in ("open", "high", "low", "close")], volume.alias("volume")).where("ts is not null")


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; one file per partition, written by the executors."""
    df.write.mode("overwrite").option("header", True).csv(path)


def normal_symbol(sector: str, symbol: Column) -> Column:
    """Symbol as its source names it: crypto without '-' and '/', USD as USDT; forex without both; stock in capitals."""
    plain = F.upper(F.translate(symbol, "-/", ""))
    if sector == "crypto":
        return F.regexp_replace(plain, "USD$", "USDT")
    if sector == "forex":
        return plain
    if sector == "stock":
        return F.upper(symbol)
    raise ValueError(f"unknown sector {sector!r}")


def normal_interval(token: str) -> str:
    """Interval in lower case, but 1M stays a month."""
    return token if token == "1M" else token.lower()


def utc_day(text: Column) -> Column:
    """YYYYMMDD as the timestamp of that day's start, null where it is none; in a session whose time zone is UTC."""
    return F.try_to_timestamp(text, F.lit("yyyyMMdd"))


def file_parts(path: Column) -> dict[str, Column]:
    """symbol, interval, period and stamp of an archive file's path or URL."""
    name = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.zip$", "")
    return {"period": F.element_at(F.split(path, "/"), -4), "symbol": F.split_part(name, F.lit("-"), F.lit(1)), "interval": F.split_part(name, F.lit("-"), F.lit(2)), "stamp": F.regexp_replace(name, r"^[^-]*-[^-]*-", "")}


def load(spark: SparkSession, sector: str, symbol: str, start: str, end: str, interval: str, folders: dict[str, str]) -> DataFrame:
    """Bars of a symbol from its sector's folder of archives or of <symbol>.csv files, as its source names it; [start, end] as YYYYMMDD.

    A sector without a folder is an error, as is an unknown one.
    """
    name = spark.range(1).select(normal_symbol(sector, F.lit(symbol))).first()[0]
    if sector not in folders:
        raise ValueError(f"no source for sector {sector!r}")
    found = read_archive(spark, f"{folders[sector]}/{name}/{normal_interval(interval)}", name) if sector == "crypto" else read_csv(spark, f"{folders[sector]}/{name}.csv", name)
    return found.where((F.col("ts") >= utc_day(F.lit(start))) & (F.col("ts") < utc_day(F.lit(end)) + F.expr("INTERVAL 1 DAY")))
