"""Repair of conversation structure by cheapest edits.

A conversation is well formed when the initials of its roles read (s?(ua)+)?.  Its rows and the four places in that pattern make a graph:
keeping, re-rolling or deleting a row leads to the next row, inserting a turn stays at the row.  Forward and backward
minimum costs from both ends mark the tight arcs, those on some cheapest way; a walk over the set of places reached takes at each step the least
letter of a tight arc, which spells the least of all cheapest edits.

Costs are kept for one in BLOCK rows and made anew block by block, so a conversation costs a byte or two per row.  Conversations go through
tasks as ordered streams: once without their texts for the faults and edits, once with them for the digest of the result, which is one value of an
ordered sequence.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, column, small_batches, stash

DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
FAR = 1 << 60
BLOCK = 4096
#: Places in the pattern: before all, behind the system turn, behind a user's, behind an assistant's; s, u and a lead from one to another.
STEP = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: The one role that may be put in at a place, and where it leads.
PUT = tuple(next((c, q) for c, q in step.items() if c != "s") for step in STEP)
FINAL = (0, FAR, FAR, 0)
LEGAL = {"su", "ua", "au"}
NAMES = {"u": "user", "a": "assistant"}


def arcs(code: str, q: int) -> list[tuple[str, int, int]]:
    """Ways to deal with a row at a place: letter, cost, next place.  code: initial, in capitals if truncated, or - for a row that must go."""
    out = [("D", DELETE, q)]
    if code != "-":
        more, c = TRUNCATED * code.isupper(), code.lower()
        if c in STEP[q]:
            out.append(("K", more, STEP[q][c]))
        out.append(("R", REROLE + more, PUT[q][1]))
    return out


_ARCS = {c: [arcs(c, q) for q in range(4)] for c in "sSuUaAxX-"}


def settle(cost: list[int], onward: bool) -> list[int]:
    """Costs at one row with the insertions there: to a place from those that lead to it, or the other way round."""
    cost = list(cost)
    for _ in range(3):
        for q in range(4):
            to = PUT[q][1]
            x, y = (to, q) if onward else (q, to)
            cost[x] = min(cost[x], cost[y] + INSERT)
    return cost


def forward(cost: list[int], code: str) -> list[int]:
    out = [FAR] * 4
    for q in range(4):
        for _, c, to in _ARCS[code][q]:
            out[to] = min(out[to], cost[q] + c)
    return settle(out, True)


def backward(cost: list[int], code: str) -> list[int]:
    return settle([min(c + cost[to] for _, c, to in _ARCS[code][q]) for q in range(4)], False)


def cheapest(codes: str) -> tuple[int, str]:
    """Least cost of making a conversation well formed, and the least of the cheapest edits' letters."""
    cost = settle(list(FINAL), False)
    tails = {len(codes): cost}
    for i in range(len(codes) - 1, -1, -1):
        cost = backward(cost, codes[i])
        if i % BLOCK == 0:
            tails[i] = cost
    best, out = cost[0], []
    head, reached = settle([0, FAR, FAR, FAR], True), {0}
    for at in range(0, max(1, len(codes)), BLOCK):
        part = codes[at : at + BLOCK]
        ahead = [tails[at + len(part)]]
        for code in reversed(part):
            ahead.append(backward(ahead[-1], code))
        ahead.reverse()
        last = at + len(part) == len(codes)
        for i in range(len(part) + last):
            while reached:
                if i == len(part) and any(FINAL[q] == 0 and head[q] == best for q in reached):
                    break
                found: dict[str, set[int]] = {}
                for q in reached:
                    if head[q] + INSERT + ahead[i][PUT[q][1]] == best:
                        found.setdefault("I", set()).add(PUT[q][1])
                    for letter, c, to in _ARCS[part[i]][q] if i < len(part) else ():
                        if head[q] + c + ahead[i + 1][to] == best:
                            found.setdefault(letter, set()).add(to)
                letter = min(found)
                out.append(letter)
                reached = found[letter]
                if letter != "I":
                    head = forward(head, part[i])
                    break
    return best, "".join(out)


class Faults:
    """Counts and codes of one conversation's rows as they come in order."""

    def __init__(self) -> None:
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = self.before = None
        self.codes = bytearray()

    def add(self, turn: int | None, initial: str, blank: bool, first: bool, cut: bool) -> None:
        if turn is not None and turn != self.high:
            self.low = turn if self.low is None else self.low
            self.high, self.turns = turn, self.turns + 1
        self.illegal += self.before is not None and self.before + initial not in LEGAL
        self.before = initial
        if blank or not first:
            self.blank, self.duplicate = self.blank + blank, self.duplicate + (not blank)
            self.codes += b"-"
        else:
            self.truncated += cut
            code = initial if initial in ("s", "u", "a") else "x"
            self.codes += (code.upper() if cut else code).encode()

    def result(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, *cheapest(self.codes.decode())


_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row with kind 0 begins each conversation."""
    names, own, held = ["conv", *_COUNTS, "audit"], None, None

    def made(rows: Iterable[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k == 7 else pa.int64()) for k, c in enumerate(cols)], names=names)

    for batch in batches:
        done = []
        for conv, kind, turn, initial, blank, first, cut in zip(*[batch.column(c).to_pylist() for c in ("conv", "kind", "turn", "initial", "blank", "first", "cut")], strict=True):
            if kind == 0:
                if held:
                    done.append((own, *held.result()))
                own, held = conv, Faults()
            else:
                held.add(turn, initial, blank, first, cut)
        if done:
            yield made(done)
    if held:
        yield made([(own, *held.result())])


class Digest:
    """SHA-256 of a repaired conversation, row by row."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.place, self.any, self.hash = audit, 0, 0, False, hashlib.sha256()

    def _write(self, role: str, text: str, place: int) -> None:
        self.hash.update(f"{chr(10) * self.any}{role}:{text}".encode("utf-8", "surrogatepass"))
        self.place, self.any = place, True

    def insertions(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            c, to = PUT[self.place]
            self._write(NAMES[c], "", to)
            self.at += 1

    def add(self, role: str, text: str) -> None:
        self.insertions()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "K":
            self._write(role, text, STEP[self.place][role[0]])
        elif letter == "R":
            c, to = PUT[self.place]
            self._write(NAMES[c], text, to)

    def hexdigest(self) -> str:
        self.insertions()
        return self.hash.hexdigest()


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own, held = None, None

    def made(conv: list, digest: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(conv, pa.int64()), pa.array(digest, pa.string())], names=["conv", "repaired_sha256"])

    for batch in batches:
        ids, digests = [], []
        for conv, kind, role, text in zip(*[batch.column(c).to_pylist() for c in ("conv", "kind", "role", "text")], strict=True):
            if kind == 0:
                if held:
                    ids.append(own)
                    digests.append(held.hexdigest())
                own, held = conv, Digest(text)
            else:
                held.add(role, text)
        if ids:
            yield made(ids, digests)
    if held:
        yield made([own], [held.hexdigest()])


def damage(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turn, role, text) with faults planted by crc32 of `conv:turn` modulo 20; null roles and texts are one space, null numbers too in that key."""
    space = F.lit(" ")
    conv, turn = column(conv_col).cast("long"), column(turn_col).cast("long")
    key = F.concat(F.coalesce(conv.cast("string"), space), F.lit(":"), F.coalesce(turn.cast("string"), space))
    rows = conversations.select(conv.alias("conv"), turn.alias("turn"), F.coalesce(column(role_col).cast("string"), space).alias("role"), F.coalesce(column(text_col).cast("string"), space).alias("text"), F.pmod(F.crc32(key.cast("binary")), F.lit(20)).alias("fate"))
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fate") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.where("fate <> 0").select("conv", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("copy")).drop("copy")


def repair(rows: DataFrame, ids: DataFrame, conv_col: str = "conv", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation of ids (those without rows too, a null id as one): conv, gaps, blank, duplicate, truncated,
    illegal, cost, audit (K, R, D, I), repaired_sha256.

    Rows stand by turn, null first, then role and a hash of role and text, then as they came.  Null roles and texts count as one space.
    A row's first fault counts: no text, a role and text seen earlier, an end other than . ! ?.  Conversations
    without rows have zeros, no edits and the digest of nothing; an empty ids gives no rows.
    """
    small_batches(rows.sparkSession)
    space = F.lit(" ")
    bare = F.rtrim(F.col("text"), F.lit(WHITE))
    held = rows.select(F.monotonically_increasing_id().alias("rid"), column(conv_col).cast("long").alias("conv"), column(turn_col).cast("long").alias("turn"), F.coalesce(column(role_col), space).alias("role"), F.coalesce(column(text_col), space).alias("text"))
    held = stash(held.withColumns({"print": F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text"), 256), "blank": bare == "", "cut": ~F.right(bare, F.lit(1)).isin(".", "!", "?")}), "damaged")
    # equal rows of a conversation are combined before they move; the first of each is known by its number
    firsts = held.where("not blank").groupBy("conv", "print").agg(F.min(F.struct(F.col("turn").isNotNull(), "turn", "rid")).alias("f")).select(F.col("f.rid").alias("frid"))
    slim = held.select("rid", "conv", "turn", "role", "print", "blank", "cut").join(firsts, F.col("rid") == F.col("frid"), "left")
    lines = slim.select("conv", F.lit(1).alias("kind"), "turn", F.left("role", F.lit(1)).alias("initial"), "blank", F.col("frid").isNotNull().alias("first"), "cut", "role", "print", "rid")
    none = {n: F.lit(None).cast(t) for n, t in lines.dtypes if n not in ("conv", "kind")}
    heads = ids.select(ids.columns[0]).distinct().toDF("conv").select(F.col("conv").cast("long"), F.lit(0).alias("kind"), *[c.alias(n) for n, c in none.items()])

    def ordered(df: DataFrame) -> DataFrame:
        order: list[Column] = [F.col(c).asc_nulls_first() for c in ("conv", "kind", "turn", "role", "print", "rid")]
        return df.repartition("conv").sortWithinPartitions(*order)

    found = ordered(lines.unionByName(heads)).drop("role", "print", "rid").mapInArrow(_edits, "conv long, " + ", ".join(f"{c} long" for c in _COUNTS) + ", audit string")
    found = stash(found, "edits")
    texts = held.select("conv", F.lit(1).alias("kind"), "turn", "role", "print", "rid", "text")
    audits = found.select("conv", F.lit(0).alias("kind"), *[F.lit(None).cast(t).alias(n) for n, t in texts.dtypes if n not in ("conv", "kind", "text")], F.col("audit").alias("text"))
    digests = ordered(texts.unionByName(audits)).select("conv", "kind", "role", "text").mapInArrow(_repaired, "conv long, repaired_sha256 string").withColumnRenamed("conv", "own")
    return found.join(digests, F.col("conv").eqNullSafe(F.col("own"))).drop("own")
