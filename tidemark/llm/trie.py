"""Prefix trie of conversations by rolling fingerprints.

Conversations that begin alike share the nodes of their common turns.  A turn becomes a SHA-256, and the prefix of d turns
the polynomial sum of x_i * B**i over its first d turns, twice with other B, modulo 2**64.  The sums come from scans in numpy over
rows in the order of conversation and turn: the rows are dealt out by range, so a long conversation lies in several partitions, each scans
its own, and one carry per partition joins them.  Equal fingerprints are candidates for a node.  Each group is verified turn by turn
against its representative: if in every group all members' last turns are equal, then so are, with B odd, the fingerprints before
them, and by induction the whole prefixes.  Where a group holds two turns the fingerprints collided, and all are made anew with other B until none does.

What a subtree sums up is rolled up without a pass for each depth: a node counts for its smallest member, its branch, and every prefix
of that conversation takes the branch's total, less what stands above it on its own branch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import column, small_batches, stash

_PRINT = [f"d{i}" for i in range(4)]
#: Ids of so many neighbouring numbers are written as one text.
BLOCK = 4096


def turn_prints(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(rid, conv, turn, d0 to d3, chars) of each row: the turn's SHA-256 as four longs and the code points of its text; null role and text are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roles, texts = batch.column("role").to_pylist(), batch.column("text").to_pylist()
            raw = b"".join([hashlib.sha256(f"{len(r)}:{r}{t}".encode("utf-8", "surrogatepass")).digest() for r, t in zip(roles, texts, strict=True)])
            words = np.frombuffer(raw, "<i8").reshape(-1, 4)
            chars = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("conv"), batch.column("turn"), *[pa.array(words[:, i]) for i in range(4)], chars], names=["rid", "conv", "turn", *_PRINT, "chars"])

    small_batches(conversations.sparkSession)
    empty = F.lit("")
    base = conversations.select(F.monotonically_increasing_id().alias("rid"), column(conv_col).cast("long").alias("conv"), column(turn_col).cast("long").alias("turn"), F.coalesce(column(role_col), empty).alias("role"), F.coalesce(column(text_col), empty).alias("text"))
    return stash(base.mapInArrow(run, "rid long, conv long, turn long, d0 long, d1 long, d2 long, d3 long, chars long"), "turns")


def share_heads(prints: DataFrame, every: int = 100, most: int = 6) -> DataFrame:
    """Rows (conv, kind, turn, d0 to d3, chars) in which each conversation c begins with the first h turns of conversation
    c - c % every, h = crc32 of c in decimal modulo most, and goes on with its own turns after its first h.

    Turns of equal number stand in the order of their prints; a null id lends nothing and has h = 0.  Only the first few turns
    of a conversation are ever numbered, so a very long one is not gathered in a task.
    """
    h = F.pmod(F.crc32(F.coalesce(F.col("conv").cast("string"), F.lit("")).cast("binary")), F.lit(most))
    order = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), *_PRINT, "rid")
    heads = stash(prints.withColumn("place", F.row_number().over(order)).where(F.col("place") < most), "heads")
    places = heads.select(F.col("rid").alias("hid"), "place")
    own = prints.join(places, F.col("rid") == F.col("hid"), "left").where(F.col("place").isNull() | (F.col("place") > h)).select("conv", F.lit(1).alias("kind"), "turn", *_PRINT, "chars")
    forks = prints.select("conv").distinct().select("conv", h.alias("h"), (F.col("conv") - F.col("conv") % every).alias("base"))
    lent = heads.withColumnRenamed("conv", "lender").join(forks, F.col("lender") == F.col("base")).where("place <= h").select("conv", F.lit(0).alias("kind"), F.col("place").cast("long").alias("turn"), *_PRINT, "chars")
    return own.unionByName(lent)


def _powers(base: int, n: np.ndarray) -> np.ndarray:
    """base ** n modulo 2**64."""
    out, square, n = np.ones(len(n), np.uint64), np.uint64(base), n.astype(np.uint64)
    with np.errstate(over="ignore"):
        for bit in range(int(n.max()).bit_length() if len(n) else 0):
            np.multiply(out, square, out=out, where=(n >> np.uint64(bit)) & np.uint64(1) == 1)
            square = square * square
    return out


def _longs(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def _scan(batches: Iterator[pa.RecordBatch], bases: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """Rows in order, with their partition, their place in it, their place in their conversation's rows there, and the two sums so far."""
    part, seq = TaskContext.get().partitionId(), 0
    last, count, sums = None, 0, [np.uint64(0), np.uint64(0)]
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        conv, none = _longs(batch, "conv"), batch.column("conv").is_null().to_numpy(zero_copy_only=False)
        goes_on = last == (bool(none[0]), int(conv[0]))
        new = np.ones(n, bool)
        new[1:] = (conv[1:] != conv[:-1]) | (none[1:] != none[:-1])
        start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        rank, first = np.arange(n) - start, start == 0
        if goes_on:
            rank[first] += count
        out = []
        for j, base in enumerate(bases):
            term = _longs(batch, f"x{j}") * _powers(base, rank)
            run = np.cumsum(term, dtype=np.uint64)
            run -= (run - term)[start]
            if goes_on:
                run[first] += sums[j]
            out.append(run)
        last, count, sums = (bool(none[-1]), int(conv[-1])), int(rank[-1]) + 1, [o[-1] for o in out]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(seq, seq + n)), pa.array(rank.astype(np.int64)), *[pa.array(o.view(np.int64)) for o in out]], names=[*batch.schema.names, "part", "seq", "rank", "s0", "s1"])
        seq += n


def _carries(scanned: DataFrame, bases: tuple[int, int]) -> dict[int, tuple]:
    """For each partition that begins within a conversation: its id, rows before, and the two sums before.  One row per partition reaches the driver."""
    ends = scanned.groupBy("part").agg(F.min(F.struct("seq", "conv")).alias("first"), F.max(F.struct("seq", "conv", "rank", "s0", "s1")).alias("last")).orderBy("part").collect()
    out, before, full = {}, None, 1 << 64
    for r in ends:
        rows, sums = r.last.rank + 1, (r.last.s0 % full, r.last.s1 % full)
        if before and before[0] == r.first.conv:
            out[r.part] = before
            if r.last.conv == r.first.conv:
                sums = tuple((b + s * pow(base, before[1], full)) % full for b, s, base in zip(before[2:], sums, bases, strict=True))
                rows += before[1]
        before = (r.last.conv, rows, *sums)
    return out


def running(rows: DataFrame, order: list[Column], x0: Column, x1: Column, bases: tuple[int, int], tag: str) -> DataFrame:
    """rows with rank, the place within its `conv` from 0 in the given order, and s0, s1, the sums of x * base**rank up to it (modulo 2**64)."""
    names, schema = rows.columns, rows.withColumns({"x0": x0, "x1": x1})
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.schema.fields) + ", part int, seq long, rank long, s0 long, s1 long"
    dealt = schema.repartitionByRange(F.col("conv"), *order).sortWithinPartitions(F.col("conv"), *order)
    scanned = stash(dealt.mapInArrow(lambda it: _scan(it, bases), kinds), tag)
    carries = scanned.sparkSession.sparkContext.broadcast(_carries(scanned, bases))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, rank = batch.column("part").to_numpy(), batch.column("rank").to_numpy().copy()
            sums = [_longs(batch, f"s{j}").copy() for j in range(2)]
            conv, none = _longs(batch, "conv").view(np.int64), batch.column("conv").is_null().to_numpy(zero_copy_only=False)
            for p in np.unique(part).tolist():
                if p in carries.value:
                    own, before, *had = carries.value[p]
                    on = (part == p) & (none if own is None else ~none & (conv == own))
                    rank[on] += before
                    for j in range(2):
                        sums[j][on] = np.uint64(had[j]) + sums[j][on] * np.uint64(pow(bases[j], before, 1 << 64))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(rank), *[pa.array(s.view(np.int64)) for s in sums]], names=[*names, "rank", "s0", "s1"])

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields) + ", rank long, s0 long, s1 long"
    return scanned.mapInArrow(finish, kept)


def _keyed(batches: Iterator[pa.RecordBatch], bases: tuple[int, int], bits: int) -> Iterator[pa.RecordBatch]:
    """Each row's fingerprint and that of the prefix before it."""
    mask = np.uint64((1 << bits) - 1)
    for batch in batches:
        rank = batch.column("rank").to_numpy()
        keys, parents = [], []
        for j, base in enumerate(bases):
            s = _longs(batch, f"s{j}")
            keys.append(s & mask)
            parents.append((s - _longs(batch, f"d{j}") * _powers(base, rank)) & mask)
        yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("rank"), *[pa.array(k.view(np.int64)) for k in keys + parents], *[batch.column(c) for c in (*_PRINT, "chars")]], names=["conv", "depth", "k0", "k1", "p0", "p1", *_PRINT, "chars"])


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest per node from its ids' texts in order."""
    node, digest = None, None
    names = ["depth", "k0", "k1", "ends_sha256"]

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*[pa.array([v], pa.int64()) for v in node], pa.array([digest.hexdigest()], pa.string())], names=names)

    for batch in batches:
        done: list[pa.RecordBatch] = []
        for *key, text in zip(*[batch.column(c).to_pylist() for c in ("depth", "k0", "k1", "ids")], strict=True):
            if key != node:
                if node is not None:
                    done.append(made())
                node, digest = key, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(text.encode())
        if done:
            yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
    if node is not None:
        yield made()


def prefix_trie(rows: DataFrame, ids: DataFrame, order: Callable[[], list[Column]] | None = None, bits: int = 64) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    rows: conv, the columns of order (default kind and turn, nulls first), d0 to d3 and chars of each turn.  ids: conv of all
    conversations, those without turns too.  saved_tokens sums (n_convs - 1) * chars over the subtree, ends_sha256 digests the ids of the
    members that end there, ascending, comma-joined.  A null id is a conversation like others, is nobody's smallest member unless alone,
    and is written as nothing, first.  Without conversations there are no rows.  bits bounds the fingerprints of the first attempt, for tests.

    The digest of a node's ids is one value of an ordered sequence, so its ids pass one task, as texts of up to 4096 ids and
    without being gathered; all else is split or combined before it moves.
    """
    spark = rows.sparkSession
    small_batches(spark)
    by = order or (lambda: [F.col("kind"), F.col("turn").asc_nulls_first()])
    zeros = {c: F.lit(0).cast("long") for c in (*_PRINT, "chars")}
    extra = [f for f in rows.schema.fields if f.name not in {"conv", *zeros}]
    roots = ids.select("conv").distinct().select("conv", F.lit(0).alias("inner"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in extra], *[c.alias(n) for n, c in zeros.items()])
    full = roots.unionByName(rows.withColumn("inner", F.lit(1)))
    attempt = 0
    while True:
        seeds = np.random.default_rng(20_260 + attempt).integers(1, 2**63, 2)
        bases = tuple(int(s) | 1 for s in seeds)
        width = min(64, bits << attempt)
        placed = running(full, [F.col("inner"), *by(), *map(F.col, _PRINT)], F.col("d0"), F.col("d1"), bases, "paths")
        kinds = "conv long, depth long, k0 long, k1 long, p0 long, p1 long, d0 long, d1 long, d2 long, d3 long, chars long"
        paths = stash(placed.mapInArrow(lambda it, b=bases, w=width: _keyed(it, b, w), kinds), "keyed")
        spread = [f(c).alias(f"{n}{c}") for c in _PRINT for n, f in (("lo", F.min), ("hi", F.max))]
        nodes = stash(paths.groupBy("depth", "k0", "k1").agg(F.min("conv").alias("conv"), F.count("*").alias("n_convs"), F.min("p0").alias("p0"), F.min("p1").alias("p1"), F.min("chars").alias("chars"), *spread), "nodes")
        if nodes.where(" or ".join(f"lo{c} <> hi{c}" for c in _PRINT)).isEmpty():
            break
        attempt += 1
    key = ["depth", "k0", "k1"]
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p0").alias("k0"), F.col("p1").alias("k1")).agg(F.count("*").alias("n_children"))
    saved = (F.col("n_convs") - 1) * F.col("chars")
    nodes = stash(nodes.join(children, key, "left").select(*key, "p0", "p1", "conv", "n_convs", saved.alias("saved"), F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children")), "family")

    # what each branch holds goes to every prefix of its conversation
    leaf = (F.col("n_children") == 0).cast("long")
    branch = nodes.groupBy("conv").agg(F.sum("saved").alias("total"), F.sum(leaf).alias("leaves")).where("total <> 0 or leaves <> 0").withColumnRenamed("conv", "owner")
    lent = paths.select("conv", *key).join(branch, F.col("conv").eqNullSafe(F.col("owner")))
    sums = lent.groupBy(*key).agg(F.sum("total").alias("all"), F.sum("leaves").alias("n_leaves"))
    above = running(nodes, [F.col("depth")], F.col("saved"), F.lit(0).cast("long"), (1, 1), "branches").withColumn("above", F.col("s0") - F.col("saved")).drop("rank", "s0", "s1")

    ended = paths.groupBy("conv").agg(F.max(F.struct(*key)).alias("end")).select("end.*", "conv")
    packs = ended.groupBy(*key, F.floor(F.col("conv") / BLOCK).alias("block")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids"))
    ends = packs.repartition(*key).sortWithinPartitions(*key, F.col("block").asc_nulls_first()).select(*key, "ids").mapInArrow(_ends, "depth long, k0 long, k1 long, ends_sha256 string")

    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k0").alias("p0"), F.col("k1").alias("p1"), F.col("conv").alias("parent_conv_id"))
    named = above.join(sums, key, "left").join(ends, key, "left").join(parents, ["depth", "p0", "p1"], "left")
    none = hashlib.sha256().hexdigest()
    return named.select(F.col("conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", (F.col("all") - F.col("above")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))
