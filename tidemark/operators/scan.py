"""Running values in two levels: over blocks of time, and inside each block.

A window over all rows of a key runs in one task, however many rows the key has.  Here each block of a key is a task of its own: what the blocks before it
leave is one row per block, scanned apart and joined back.  Blocks must follow the order of the rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400


def day_of(ts: str | Column) -> Column:
    """Blocks of a day for rows in order of a timestamp."""
    return F.floor(F.unix_seconds(ts) / DAY)


def blocks(df: DataFrame, ts: str) -> Column:
    """Blocks of rows in order of ts: days of a timestamp; other kinds are one block, as their scale is not known."""
    kind = df.schema[ts].dataType.simpleString()
    return day_of(F.col(ts).cast("timestamp")) if kind.startswith("timestamp") else F.lit(0)


def _carried(df: DataFrame, keys: list[str], total: Column, carry: Column) -> DataFrame:
    """df with _carry: the carry over the totals of its key's other blocks."""
    blocks = df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_block").alias("_b")).agg(total.alias("_total"))
    left = blocks.select(*[f"_k{i}" for i in range(len(keys))], "_b", carry.alias("_carry"))
    met = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)] + [F.col("_block").eqNullSafe(F.col("_b"))]
    return df.join(left, reduce(lambda a, b: a & b, met), "left").drop("_b", *[f"_k{i}" for i in range(len(keys))])


def _over(keys: list[str], forward: bool = True) -> Column:
    of = Window.partitionBy(*[f"_k{i}" for i in range(len(keys))])
    return of.orderBy(F.col("_b") if forward else -F.col("_b")).rowsBetween(Window.unboundedPreceding, -1)


def running_sum(df: DataFrame, keys: list[str], order: list[str], value: Column, block: Column, name: str) -> DataFrame:
    """df with the sum of value up to and with each row, in the order given."""
    cut = df.withColumns({"_block": block, "_v": value})
    inside = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    made = _carried(cut, keys, F.sum("_v"), F.sum("_total").over(_over(keys)))
    zero = F.lit(0)
    return made.withColumn(name, F.sum("_v").over(inside) + F.coalesce("_carry", zero)).drop("_block", "_v", "_carry")


def running_last(df: DataFrame, keys: list[str], order: list[Column], value: str, block: Column, name: str, forward: bool = True, rows: bool = True) -> DataFrame:
    """df with the last value that is not null up to each row.

    rows: order is that of rows, the row itself counts.  Otherwise order is one number and only rows whose number is lower by one or more
    count.  Not forward: order and blocks run from the end, so the value is the next one.
    """
    cut = df.withColumn("_block", block)
    at = F.struct(*order)
    frame = Window.partitionBy(*keys, "_block").orderBy(*order)
    inside = frame.rowsBetween(Window.unboundedPreceding, 0) if rows else frame.rangeBetween(Window.unboundedPreceding, -1)
    last = F.max_by(F.when(F.col(value).isNotNull(), F.col(value)), F.when(F.col(value).isNotNull(), at))
    made = _carried(cut, keys, last, F.last("_total", ignorenulls=True).over(_over(keys, forward)))
    return made.withColumn(name, F.coalesce(F.last(value, ignorenulls=True).over(inside), "_carry")).drop("_block", "_carry")
