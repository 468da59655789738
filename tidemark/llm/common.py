"""Helpers that several corpus operators share."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the class [\x20\x09-\x0D].
WHITE = " \t\n\x0b\x0c\r"
#: Rows of at most this many small keys may be broadcast; beyond, the join shuffles.
BROADCAST_ROWS = 500_000


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or in local runs without it a new one."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tidemark-")
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def stash(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage ends there, and ids made
    by monotonically_increasing_id() stay what they are when an executor is lost."""
    path = f"{shared_folder(df.sparkSession)}/{tag}-{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds, as texts can be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def column(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def text_of(name: str) -> Column:
    """The text column, null as empty."""
    return F.coalesce(column(name).cast("string"), F.lit(""))


def few(df: DataFrame, most: int = BROADCAST_ROWS) -> bool:
    """Whether df has at most so many rows; reads no more than needed to tell."""
    return df.limit(most + 1).count() <= most


def spare(df: DataFrame, *names: str) -> list[str]:
    """Column names like these that df does not have (whatever their case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def numbered(docs: DataFrame, text_col: str) -> DataFrame:
    """docs with its columns under the names c0, c1, ... and its text once more as `judged`, for a pass in Arrow."""
    return docs.select(*[column(c).alias(f"c{i}") for i, c in enumerate(docs.columns)], column(text_col).cast("string").alias("judged"))


def within(sample: DataFrame, id_col: str, text_col: str, room: int) -> DataFrame:
    """The rows of a sample whose texts, in the order of their ids, fit into `room` code points in all; a text without
    room is left out and a later, shorter one may still fit.  One number per id reaches the driver."""
    over = []
    sizes = sample.groupBy(id_col).agg(F.sum(F.char_length(text_col)).alias("n")).collect()
    for r in sorted(sizes, key=lambda r: (r[0] is None, r[0])):
        if (r.n or 0) <= room:
            room -= r.n or 0
        else:
            over.append(r[0])
    out = F.coalesce(F.col(id_col).isin([i for i in over if i is not None]), F.lit(None in over))
    return sample.where(~out) if over else sample


def keep_rows(docs: DataFrame, verdict: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of docs that verdict keeps, with the columns of docs, whatever these are called.

    verdict has for each row of docs: doc_id, th (xxhash64 of the text, null as empty), kept.  Rows
    that agree in id and text are one row repeated; if any of them is kept, one stays.  The drop list is
    broadcast only when it is counted to be small, else the anti join shuffles.
    """
    th, vid, vth = spare(docs, "th", "vid", "vth")
    tagged = docs.withColumn(th, F.xxhash64(text_of(text_col)))
    votes = stash(
        verdict.groupBy("doc_id", "th").agg(F.max("kept").alias("kept"), F.count("*").alias("n"))
        .where("not kept or n > 1"),
        "votes",
    )

    def on(keys: DataFrame, how: str, frame: DataFrame = tagged) -> DataFrame:
        keys = keys.select(F.col("doc_id").alias(vid), F.col("th").alias(vth))
        keys = F.broadcast(keys) if small else keys
        return frame.join(keys, (F.col(th) == F.col(vth)) & column(id_col).eqNullSafe(F.col(vid)), how)

    small = few(votes)
    kept = on(votes.where("not kept"), "left_anti")
    twice = votes.where("kept")
    if not twice.isEmpty():
        once = on(twice, "left_semi", kept).dropDuplicates([id_col, th])
        kept = on(twice, "left_anti", kept).unionByName(once)
    return kept.select(*map(column, docs.columns))
