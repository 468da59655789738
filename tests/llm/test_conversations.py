import hashlib
import heapq
import itertools
import random
import zlib

import pytest

from tidemark.llm import repair, trie
from tidemark.llm.queries import QUERIES

WHITE = " \t\n\x0b\x0c\r"
NEXT = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}]


def plain_edits(rows):
    """Cheapest edits of (initial, must go, truncated) rows: all scripts by cost, then letters."""
    heap, seen = [(0, "", 0, 0)], set()
    while heap:
        cost, letters, i, q = heapq.heappop(heap)
        if i == len(rows) and q in (0, 3):
            return cost, letters
        if (i, q) in seen:
            continue
        seen.add((i, q))
        for c in "ua":
            if c in NEXT[q]:
                heapq.heappush(heap, (cost + 2, letters + "I", i, NEXT[q][c]))
        if i < len(rows):
            initial, gone, cut = rows[i]
            heapq.heappush(heap, (cost + 3, letters + "D", i + 1, q))
            if not gone:
                for c, letter, price in [(initial, "K", 0), ("u", "R", 2), ("a", "R", 2)]:
                    if c in NEXT[q]:
                        heapq.heappush(heap, (cost + price + cut, letters + letter, i + 1, NEXT[q][c]))


def plain_repair(table):
    out, by = {}, {c: [] for c, *_ in table}
    for c, t, r, x in table:
        r, x = (" " if v is None else v for v in (r, x))
        fate = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        x = "" if fate == 1 else "".join(y for y in x if y not in ".!?") if fate == 2 else x
        by[c] += [(t, "user" if fate == 4 else r, x)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    for c, rows in by.items():
        rows.sort(key=lambda p: (p[0] is not None, p[0] or 0))
        seen, marked, blank, duplicate, truncated = set(), [], 0, 0, 0
        for _, r, x in rows:
            bare = x.rstrip(WHITE)
            kind = "b" if not bare else "d" if (r, x) in seen else "t" if bare[-1] not in ".!?" else ""
            seen.add((r, x))
            blank, duplicate, truncated = blank + (kind == "b"), duplicate + (kind == "d"), truncated + (kind == "t")
            marked.append((r[:1], kind in ("b", "d"), kind == "t"))
        cost, letters = plain_edits(marked)
        result, q, i = [], 0, 0
        for y in letters:
            put = next((c for c in "ua" if c in NEXT[q]), None)
            name = {"u": "user", "a": "assistant"}[put]
            if y == "I":
                result.append(f"{name}:")
            elif y == "R":
                result.append(f"{name}:{rows[i][2]}")
            elif y == "K":
                result.append(f"{rows[i][1]}:{rows[i][2]}")
                put = rows[i][1][0]
            q = q if y == "D" else NEXT[q][put]
            i += y != "I"
        turns = {t for t, *_ in rows if t is not None}
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
        out[c] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, blank, duplicate, truncated, illegal, cost, letters, hashlib.sha256("\n".join(result).encode()).hexdigest())
    return out


def talks(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, conv string, kind string")


def odd_table(seed, most=60):
    draw = random.Random(seed)
    rows = []
    for c in [*range(most), None, -7, 10_005]:
        turns = draw.sample([None, *range(12)], draw.randrange(1, 9))
        rows += [(c, t, draw.choice(["user", "assistant", "system", "tool", "", None]) if draw.random() < 0.4 else ["user", "assistant"][(t or 0) % 2], draw.choice(["Yes.", "No!", "why", " ", None, "Well?\n", "é🙂.", "a\nb"])) for t in turns]
    return rows


def test_edits_equal_all_scripts(monkeypatch):
    draw = random.Random(3)
    for codes in [*("".join(p) for n in range(5) for p in itertools.product("suaUx-", repeat=n)), *("".join(draw.choice("suaSUAxX-") for _ in range(draw.randrange(60))) for _ in range(100))]:
        want = plain_edits([(c.lower(), c == "-", c.isupper()) for c in codes])
        for block in (1, 3, 4096):
            monkeypatch.setattr(repair, "BLOCK", block)
            assert repair.cheapest(codes) == want, codes


def test_repair_equals_plain(spark):
    rows = odd_table(5)
    df = talks(spark, rows)
    got = {r.conv: tuple(r)[1:] for r in repair.repair(repair.damage(df), df.select("conv_id")).collect()}
    assert got == plain_repair(rows)


def test_repair_of_a_long_conversation_and_repeated_rows(spark):
    rows = [(1, k, ["user", "assistant"][k % 2], "Same.") for k in range(3000)] + [(2, 5, "user", "twice")] * 3
    df = talks(spark, rows)
    got = {r.conv: tuple(r)[1:] for r in repair.repair(repair.damage(df), df.select("conv_id")).collect()}
    assert got == plain_repair(rows)


def test_query_11_equals_plain(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: tuple(r)[1:] for r in QUERIES["op11_conversation_repair"](spark, sf).collect()}
    assert got == plain_repair(rows)


def plain_trie(rows, heads=True):
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append(((t is not None, t or 0), (r or "", x or "")))
    by = {c: [m for _, m in sorted(v, key=lambda p: p[0])] for c, v in by.items()}
    built = {}
    for c in by:
        h = zlib.crc32(b"" if c is None else str(c).encode()) % 6
        built[c] = tuple((by.get(c - int(c % 100 if c >= 0 else -(-c % 100)), [])[:h] if c is not None else []) + by[c][h:])
    nodes, kids, leaves, saved, out = {}, {}, {}, {}, set()
    for c, m in built.items():
        for d in range(len(m) + 1):
            nodes.setdefault(m[:d], []).append(c)
    for p in nodes:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    least = lambda ids: min((c for c in ids if c is not None), default=None)
    for p in sorted(nodes, key=len, reverse=True):
        below = kids.get(p, [])
        leaves[p] = sum(leaves[k] for k in below) or 1
        saved[p] = sum(saved[k] for k in below) + ((len(nodes[p]) - 1) * len(p[-1][1]) if p else 0)
        ends = sorted((c for c in nodes[p] if len(built[c]) == len(p)), key=lambda c: (c is not None, c or 0))
        digest = hashlib.sha256(",".join("" if c is None else str(c) for c in ends).encode()).hexdigest()
        out.add((least(nodes[p]), len(p), least(nodes[p[:-1]]) if p else None, len(nodes[p]), len(below), leaves[p], saved[p], digest))
    return out


def trie_of(spark, rows, **more):
    prints = trie.turn_prints(talks(spark, rows))
    return [tuple(r) for r in trie.prefix_trie(trie.share_heads(prints), prints.select("conv"), **more).collect()]


def forks(seed):
    draw = random.Random(seed)
    rows = [(c, t if t or draw.random() > 0.1 else None, draw.choice(["user", "assistant", None]), draw.choice(["a", "b", "hello", None, ""])) for c in [*range(150), 1005, 100_001, -103, None] for t in range(draw.randrange(1, 9))]
    return rows + [(50, k + 20, "user", str(k)) for k in range(700)] + [(c, 0, "system", "same") for c in range(20_000, 20_250)]


@pytest.mark.parametrize("bits", [64, 5])
def test_trie_equals_plain(spark, bits):
    """Rows over several partitions, so that sums are carried over; with 5 bits fingerprints collide and are made anew."""
    rows = forks(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = trie_of(spark, rows, bits=bits)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == len(set(got)) and set(got) == plain_trie(rows)


def test_query_13_equals_plain(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = [tuple(r) for r in QUERIES["op13_prefix_trie"](spark, sf).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_trie(rows)
