"""Exact deduplication by two passes over fingerprints and a Bloom filter of repeated hashes.

Pass one hashes every normalised text and counts the hashes exactly, 8 bytes a row and combined before they move; those
met twice enter a Bloom filter of bounded size, so its load depends on the repeated texts only.  The filter carries that answer to pass two,
which asks it: a row that it does not know is unique and passes straight through; only the others shuffle by their
full SHA-256.  So the count finds the repeated hashes and the filter brings them to the rows, as no built-in aggregate tells a second
sight of a hash within a task; false positives merely shuffle, and the result is exact whatever the filter's load.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, column, keep_rows, stash, text_of

#: bitmap_construct_agg() makes bitmaps of this many bits.
PART_BITS = 32768


def _bit(bitmap: str, cell: Column) -> Column:
    """Whether the bit of a cell is set in the bitmap of its part; a null bitmap has none."""
    place = (cell % PART_BITS).cast("int")
    byte = F.conv(F.hex(F.substring(F.col(bitmap), (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.bit_get(byte, place % 8) == 1, F.lit(False))


def repeated_filter(keys: DataFrame, key: str, bits_per_key: int, max_bits: int, hashes: int) -> tuple[DataFrame, list[Column]]:
    """Bitmaps (part, bits) of the keys that stand in two rows or more, and the cells of each row's key."""
    hashed = F.xxhash64(F.col(key))
    again = stash(keys.groupBy(hashed.alias("h")).agg(F.count("*").alias("n")).where("n > 1").select("h"), "repeated")
    bits, wanted = PART_BITS, min(bits_per_key * again.count(), max_bits)
    while bits < wanted:
        bits *= 2

    def cells(h: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(h, F.lit(i)), F.lit(bits)) for i in range(hashes)]

    met = again.select(F.explode(F.array(*cells(F.col("h")))).alias("cell"))
    part = F.floor(F.col("cell") / PART_BITS).cast("long")
    maps = met.groupBy(part.alias("part")).agg(F.bitmap_construct_agg(F.col("cell") % PART_BITS).alias("bits"))
    return maps, cells(hashed)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits_per_key: int = 16, max_filter_bits: int = 1 << 28, hashes: int = 2) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, th.

    Texts are equal when identical without ASCII white space; null counts as empty, and all empty
    texts are one group.  Of a group the row with the most code points of the original text stays,
    then the smallest doc_id (null last), then one of the repeated rows.  The broadcast filter never
    exceeds max_filter_bits / 8 bytes.  An empty table gives no rows.
    """
    text = text_of(text_col)
    prints = stash(
        docs.select(
            column(id_col).alias("doc_id"), F.sha2(F.translate(text, WHITE, ""), 256).alias("text_sha256"),
            F.char_length(text).alias("n"), F.xxhash64(text).alias("th"), F.monotonically_increasing_id().alias("rid"),
        ),
        "exact",
    )
    maps, cells = repeated_filter(prints, "text_sha256", bits_per_key, max_filter_bits, hashes)
    maps = stash(maps, "bloom")
    asked, maybe = prints, F.lit(True)
    for i, cell in enumerate(cells):
        own = maps.select(F.col("part").alias(f"p{i}"), F.col("bits").alias(f"b{i}"))
        asked = asked.join(F.broadcast(own), F.floor(cell / PART_BITS).cast("long") == F.col(f"p{i}"), "left")
        maybe &= _bit(f"b{i}", cell)
    asked = asked.select("doc_id", "text_sha256", "n", "th", "rid", maybe.alias("maybe"))
    alone = asked.where("not maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256", "th")
    again = asked.where("maybe")
    best = F.min(F.struct(-F.col("n"), F.col("doc_id").isNull(), F.col("doc_id"), F.col("rid")))
    # written apart from the join, so that a large group's rows are split over tasks there
    groups = stash(again.groupBy(F.col("text_sha256").alias("g")).agg(F.count("*").alias("group_size"), best.alias("best")), "groups")
    return alone.unionByName(
        again.join(groups, F.col("text_sha256") == F.col("g")).select(
            "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("rid") == F.col("best.rid")).alias("kept"), "text_sha256", "th",
        )
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with the columns of docs."""
    return keep_rows(docs, exact_groups(docs, id_col, text_col), id_col, text_col)
