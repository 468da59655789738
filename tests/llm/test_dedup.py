import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.llm import decontam, exact_dedup, graph, langid, line_dedup, near_dedup

from . import cases


def test_exact_groups_match_plain_grouping(spark):
    rows = [r.asDict() for r in exact_dedup.exact_groups(cases.docs(spark)).collect()]
    assert len(rows) == len(cases.ROWS)
    groups = defaultdict(list)
    for i, text, *_ in cases.ROWS:
        groups["".join(c for c in text or "" if c not in " \t\n\x0b\x0c\r")].append((-len(text or ""), i is None, i or 0))
    sizes = sorted(len(g) for g in groups.values() for _ in g)
    assert sorted(r["group_size"] for r in rows) == sizes
    assert sum(r["kept"] for r in rows) == len(groups)
    by_id = {r["doc_id"]: r for r in rows if r["doc_id"] not in (None, 13)}
    assert by_id[4]["keep_id"] == by_id[5]["keep_id"] == 5  # the longer text stays
    assert by_id[1]["keep_id"] == 3 and by_id[1]["group_size"] == 3  # null, empty and blank are one group


def test_saturated_filter_changes_nothing(spark):
    docs = cases.docs(spark)
    cols = ["doc_id", "keep_id", "group_size", "kept"]
    full = exact_dedup.exact_groups(docs, max_filter_bits=1, bits_per_key=0).select(cols)
    assert sorted(map(str, full.collect())) == sorted(map(str, exact_dedup.exact_groups(docs).select(cols).collect()))


def test_unique_rows_do_not_reach_the_join(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 20, "same").otherwise(F.sha2(F.col("id").cast("string"), 256)).alias("text"))
    prints = docs.select(F.sha2("text", 256).alias("k"))
    maps, cells = exact_dedup.repeated_filter(prints, "k", 16, 1 << 20, 2)
    bits = maps.agg(F.sum(F.bitmap_count("bits"))).first()[0]
    assert 2 <= bits < 200  # the repeated text's cells and a few chance meetings


def test_drop_exact_copies_keeps_one_row_of_twins(spark):
    docs = cases.docs(spark)
    kept = exact_dedup.drop_exact_copies(docs)
    assert kept.columns == docs.columns
    texts = [r.text for r in kept.select("text").collect()]
    assert texts.count("twin row") == texts.count("twin null") == 1
    assert "Hello world" not in texts and "Hello  world\n" in texts


@pytest.mark.parametrize("percent", [80, 85])
def test_near_groups_match_all_pairs(spark, percent):
    rows = near_dedup.near_groups(cases.docs(spark), percent=percent).collect()
    assert len(rows) == len(cases.ROWS)
    unique = {i: t for i, t, *_ in cases.ROWS if i is not None}
    want = cases.components(unique, percent)
    for r in rows:
        if r.doc_id is not None:
            assert r.component_id == want[r.doc_id]
            assert r.n_shingles == len(cases.shingles(unique[r.doc_id]))
            assert r.kept == (want[r.doc_id] == r.doc_id)
    # repeated rows are kept alike, one of them is chosen; blank ones too
    assert [sum(r[c] for r in rows if r.doc_id == 13) for c in ("kept", "chosen")] == [2, 1]
    twice = near_dedup.near_groups(cases.docs(spark, [(2, " ", "en", "a"), (2, " ", "en", "a")]), percent=percent).collect()
    assert [(r.kept, r.component_id) for r in twice] == [(True, 2)] * 2
    assert near_dedup.drop_near_copies(cases.docs(spark, [(2, " ", "en", "a"), (2, " ", "en", "a")]), percent=percent).count() == 1
    assert [r.component_id for r in rows if r.doc_id is None] == [None] * 3


def test_near_groups_in_a_crowd_lose_no_link(spark):
    draw = random.Random(5)
    texts = {i: cases.near(draw.sample(range(60), draw.choice([0, 1, 1, 2, 3, 5]))) + (" end" * (i % 3)) for i in range(150)}
    got = {r.doc_id: r.component_id for r in near_dedup.near_groups(cases.docs(spark, [(i, t, "en", "a") for i, t in texts.items()]), percent=85).collect()}
    assert got == cases.components(texts, 85)


def test_a_bucket_of_thousands_without_links_stays_linear(spark, monkeypatch):
    """A template in all texts puts thousands into one bucket though none links; a short text keeps the bucket open."""
    draw = random.Random(9)
    common = [f"common{k}" for k in range(200)]
    rows = [(i, " ".join(common[: 150 + i % 10] + [f"w{draw.randrange(10**9)}" for _ in range(45)]), "en", "a") for i in range(5000)]
    rows += [(9000, " ".join(common[:130]), "en", "a"), (9001, " ".join(common[:130] + ["end"]), "en", "a")]
    asked = []
    plain = near_dedup.stash

    def seen(df, tag):
        out = plain(df, tag)
        if tag == "prefixes":
            asked.append(out.alias("x").join(out.alias("y"), F.expr("x.h = y.h and x.node < y.node")).count())
        return out

    monkeypatch.setattr(near_dedup, "stash", seen)
    monkeypatch.setattr(near_dedup, "band_rows", lambda percent: 1)
    got = {r.doc_id: r.component_id for r in near_dedup.near_groups(cases.docs(spark, rows), percent=85).collect()}
    assert got == {i: i for i in range(5000)} | {9000: 9000, 9001: 9000}
    assert asked and asked[0] < 100_000


def test_drop_near_copies_keeps_one_of_each(spark):
    kept = near_dedup.drop_near_copies(cases.docs(spark), percent=85)
    ids = sorted(r.doc_id for r in kept.select("doc_id").where("doc_id is not null").collect())
    want = cases.components({i: t for i, t, *_ in cases.ROWS if i is not None}, 85)
    assert ids == sorted(set(want.values()))


def test_estimate_is_near_the_truth(spark):
    a, b = cases.BASE, cases.near([10])
    family = near_dedup._family()
    sets = [near_dedup.shingle_hashes(t) for t in (a, b)]
    packs = [near_dedup.signature(s, family)[1].tolist() for s in sets]
    df = spark.createDataFrame([tuple(packs)], "x array<long>, y array<long>")
    got = df.select(near_dedup.estimate(F.col("x"), F.col("y"))).first()[0]
    truth = len(set(sets[0]) & set(sets[1])) / len(set(sets[0]) | set(sets[1]))
    assert abs(got - truth) < 0.15


def test_components_of_chains_and_cycles(spark):
    edges = [(k + 1, k) for k in range(100, 140)] + [(1, 2), (2, 3), (3, 1), (9, 7)]
    got = {r.node: r.label for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 100 for k in range(100, 141)}, 1: 1, 2: 1, 3: 1, 7: 7, 9: 7}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("table_lines", [200_000, 0])
def test_line_dedup_matches_plain_counting(spark, table_lines, monkeypatch):
    draw = random.Random(3)
    lines = [f"line {k}" for k in range(30)] + [""]
    rows = [(i, "\n".join(draw.choice(lines[: 5 + i % 26] + lines[-1:]) for _ in range(8)), "en", f"s{draw.randrange(12)}") for i in range(80)] + [(90, None, "en", None), (90, None, "en", None), (None, "line 1", "en", "s1")]
    sites = defaultdict(set)
    for _, text, _, site in rows:
        for line in (text or "").split("\n"):
            sites[line].add(site)
    wide = {x for x, s in sites.items() if x and len(s) >= 10}
    assert wide
    if not table_lines:
        monkeypatch.setattr(line_dedup, "few", lambda df: False)
    got = line_dedup.drop_spread_lines(cases.docs(spark, rows), min_sites=10, table_lines=table_lines).collect()
    clean = {i: "\n".join(x for x in (t or "").split("\n") if x not in wide) for i, t, *_ in rows}
    assert len(got) == len(rows)
    for r in got:
        assert r.text == clean[r.doc_id]
        assert r.n_lines - r.n_removed == (clean[r.doc_id].count("\n") + 1 if r.n_removed < r.n_lines else 0)


CLASHES = ["th", "vid", "vth", "judged", "_th", "_vid", "_vth", "rid", "node", "band", "h", "site", "w", "kept", "drop", "group_size", "t", "c"]


@pytest.mark.parametrize("name", ["exact", "near", "leaks", "language"])
def test_rows_keep_their_columns_whatever_they_are_called(spark, name):
    """Another text column beside one called text, and the users' columns under every name that an operator uses itself."""
    keep = {
        "exact": lambda d: exact_dedup.drop_exact_copies(d, text_col="body"), "near": lambda d: near_dedup.drop_near_copies(d, text_col="body"),
        "leaks": lambda d: decontam.drop_leaks(d, spark.createDataFrame([(1, "some line that nobody has ever copied into any text")], "item_id long, text string"), text_col="body"),
        "language": lambda d: langid.keep_identified(d, langid.train(d, text_col="body"), text_col="body"),
    }[name]
    rows = [(i, t, "en", f"other text {k}", k + 0.5, *[700 + j for j in range(len(CLASHES))]) for k, (i, t, *_) in enumerate(cases.ROWS)]
    schema = "doc_id long, body string, lang string, text string, `a.b` double, " + ", ".join(f"{c} long" for c in CLASHES)
    docs = spark.createDataFrame(rows, schema)
    got = [tuple(r) for r in keep(docs).collect()]
    assert got and set(got) <= set(rows) and keep(docs).schema == docs.schema
    plain = {"exact": exact_dedup.drop_exact_copies, "near": near_dedup.drop_near_copies}.get(name)
    if plain:
        assert sorted(r[1] or "" for r in got) == sorted(r.text or "" for r in plain(cases.docs(spark)).collect())
    elif name == "leaks":
        assert sorted(map(str, got)) == sorted(map(str, rows))
    else:
        assert {r[0] for r in rows} - {r[0] for r in got} >= {1, 2, 3, 14}
