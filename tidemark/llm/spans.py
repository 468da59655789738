"""Spans of regular expressions as columns, without leaving the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_TYPE = "array<struct<s:int,e:int,k:int,v:string,b:string>>"
#: Spans are appended to lists of at most so many, as each append copies its list.
CHUNK = 256


def spans(text: Column, pattern: str, kind: int, keep: Callable[[Column], Column] | None = None, window: int = 0) -> Column:
    """Array of (s, e, k, v, b): leftmost non-overlapping matches of a Java pattern in code points, end
    exclusive, k the kind's number, v the matched text, b up to window code points before it; keep filters by v.

    split() gives what stands between the matches, so running lengths give their places.  They are summed chunk by chunk, and what
    stands before a match is cut from the gap and the end of what came before, so the work is linear in the text and its spans.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    empty = F.array().cast(_TYPE)
    none = F.lit("")

    def tail(*parts: Column) -> Column:
        return F.right(F.concat(*parts), F.lit(window)) if window else none

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.char_length(x["g"])
        end = start + F.char_length(x["v"])
        before = tail(acc["tail"], x["g"])
        one = F.struct(start.alias("s"), end.alias("e"), F.lit(kind).alias("k"), x["v"].alias("v"), before.alias("b"))
        return F.struct(end.alias("at"), tail(before, x["v"]).alias("tail"), F.concat(acc["all"], F.array(one)).alias("all"))

    def chunk(acc: Column, part: Column) -> Column:
        first = F.struct(acc["at"].alias("at"), acc["tail"].alias("tail"), empty.alias("all"))
        return F.aggregate(part, first, step, lambda made: F.struct(made["at"].alias("at"), made["tail"].alias("tail"), F.concat(acc["lists"], F.array(made["all"])).alias("lists")))

    zipped = F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("g"), found.alias("v"))
    # bound to a name, so that the matches are found once and not for each chunk
    chunks = F.transform(F.array(zipped), lambda z: F.transform(F.sequence(F.lit(0), F.floor((F.size(z) - 1) / CHUNK)), lambda i: F.slice(z, (i * CHUNK + 1).cast("int"), F.lit(CHUNK))))[0]
    begin = F.struct(F.lit(0).alias("at"), none.alias("tail"), F.array().cast(f"array<{_TYPE}>").alias("lists"))
    walked = F.aggregate(chunks, begin, chunk, lambda acc: F.flatten(acc["lists"]))
    kept = walked if keep is None else F.filter(walked, lambda x: keep(x["v"]))
    return F.when(text.rlike(pattern), kept).otherwise(empty)


def ordered(*arrays: Column) -> Column:
    """All spans by start, then kind, then end."""
    return F.transform(
        F.array_sort(F.transform(F.concat(*arrays), lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), x["v"].alias("v"), x["b"].alias("b")))),
        lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k"), x["v"].alias("v"), x["b"].alias("b")),
    )


def written(found: Column, kinds: list[str]) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, kinds))
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def count_kind(found: Column, kind: int) -> Column:
    return F.size(F.filter(found, lambda x: x["k"] == kind)).cast("long")
