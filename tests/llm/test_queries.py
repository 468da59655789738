import hashlib
import random
import re

import pytest

from tidemark.llm import bpe, decontam, exact_dedup, line_dedup, near_dedup, pii, secrets, toxicity
from tidemark.llm.queries import QUERIES, vocabulary_path

from . import cases

EMPTY = {
    "exact": exact_dedup.exact_groups, "near": near_dedup.near_groups, "lines": line_dedup.drop_spread_lines, "pii": lambda d: pii.pii_digest(pii.find_pii(d)), "secrets": lambda d: secrets.secret_digest(secrets.find_secrets(d)),
    "bpe": lambda d: bpe.token_digest(d, vocabulary_path()), "tox": lambda d: toxicity.score_documents(d, toxicity.fit([], [])),
    "drop exact": exact_dedup.drop_exact_copies, "drop near": near_dedup.drop_near_copies, "leaks": lambda d: decontam.find_leaks(d, d.selectExpr("doc_id item_id", "text")),
}


@pytest.mark.parametrize("name", EMPTY)
def test_empty_tables_give_no_rows(spark, name):
    assert EMPTY[name](cases.docs(spark, [])).count() == 0


def folder(spark, path, rows, labels=(), items=(), talks=()):
    """A folder of tables as the queries read them."""
    cases.docs(spark, rows).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(talks), "conv_id long, turn long, role string, text string, conv string, kind string, depth int").write.parquet(f"{path}/conversations.parquet")
    spark.createDataFrame(list(items), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_queries_on_empty_tables(spark, tmp_path):
    import corpus_pipeline

    path = folder(spark, tmp_path / "none", [])
    for name, query in QUERIES.items():
        made = query(spark, path)
        assert made.columns and made.count() == 0, name
    assert corpus_pipeline.run(spark, path).count() == 0


def test_queries_on_odd_tables(spark, tmp_path):
    """Null ids and texts, blank and very long texts, repeated rows, clashing columns: one row per document in each result."""
    labels = [(6, 1, 0), (7, 0, 1), (7, 0, 1), (None, 1, 1), (99, 0, 0)]
    path = folder(spark, tmp_path / "odd", cases.ROWS, labels, [(1, "some item that no text has at all"), (2, None), (None, "")], [(None, None, None, None, "c", "k", 1), (3, 1, None, "", "c", "k", 1), (3, 1, None, "", "c", "k", 1)])
    # conversation 3 loses the first of its repeated turns, and the null conversation has one turn like the other: a root and one node
    for name, query in QUERIES.items():
        n = query(spark, path).count()
        assert n == {"op10": 0, "op11": 2, "op13": 2}.get(name.split("_")[0], len(cases.ROWS)), name


def test_one_query_for_each_operator():
    assert [q.split("_")[0] for q in QUERIES] == [f"op{k}" for k in range(1, 14)]


def test_pipeline_equals_plain_steps(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = corpus_pipeline.run(spark, sf).collect()
    ids = {r.doc_id for r in out}
    assert len(ids) == len(out) and ids <= set(docs)
    # exact copies: one of each group at most; near copies: no two linked documents are left
    bare = ["".join(docs[i].text.split()) for i in ids]
    assert len(set(bare)) == len(bare)
    left = cases.components({i: docs[i].text for i in ids}, 80)
    assert all(i == c for i, c in left.items())
    # what went has a reason
    leaks = {r.doc_id for r in decontam.find_leaks(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    assert not ids & leaks
    groups = cases.components({i: d.text for i, d in docs.items()}, 80)
    lonely = {i for i in docs if list(groups.values()).count(groups[i]) == 1} - leaks
    assert len(lonely - ids) <= 1


def plain_words(text):
    return re.sub(r"[^0-9a-z\x80-\U0010ffff]+", " ", (text or "").lower()).split()


def test_pipeline_equals_plain_stages(spark, tmp_path):
    """All five stages on a small corpus by plain Python: grouping, all pairs, aligning everything, the tokenizers library."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    from tidemark.llm import langid

    from .test_models import plain_alignment

    draw = random.Random(21)
    rows = [r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source").orderBy("doc_id").limit(150).collect() if len(r.text or "") < 4000]
    rows = [tuple(r) for r in rows]
    items = [(k, " ".join(draw.choice(cases.WORDS) + draw.choice("abc") for _ in range(25))) for k in range(3)]
    long = max((r for r in rows if r[1]), key=lambda r: len(r[1]))
    words = long[1].split(" ")
    changed = " ".join(w if i != len(words) // 2 else "another" for i, w in enumerate(words))
    rows += [(5001, None, "en", "a"), (5002, "", "en", "a"), (5003, "12 34 !!", "en", "a"), (5004, f"  {long[1]}\n", long[2], "b"), (5005, changed, long[2], "b"), (5006, long[1], long[2], "b"), (5006, long[1], long[2], "b"), (5007, f"{long[1][:200]} {items[0][1]}", long[2], "c")]
    path = folder(spark, tmp_path / "small", rows, items=items)
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, path).collect()}

    docs = cases.docs(spark, rows)
    rejected = {r.doc_id for r in langid.identify(docs, langid.train(docs)).collect() if r.rejected}
    assert {5001, 5002, 5003} <= rejected
    left = {r[0]: r[1] for r in rows if r[0] not in rejected}
    groups = {}
    for i, t in left.items():
        groups.setdefault("".join(c for c in t if c not in " \t\n\x0b\x0c\r"), []).append((-len(t), i))
    left = {min(g)[1]: left[min(g)[1]] for g in groups.values()}
    left = {i: left[i] for i, c in cases.components(left, 80).items() if i == c}
    clean = {}
    for i, t in left.items():
        own = plain_words(t)
        if not any(plain_alignment(plain_words(x), own) >= 0.8 * len(plain_words(x)) for _, x in items):
            clean[i] = t
    library = Tokenizer.from_file(vocabulary_path())
    assert set(got) == set(clean) and 5007 not in clean and len({5004, 5005, 5006, long[0]} & set(clean)) == 1
    for i, t in clean.items():
        ids = library.encode(t, add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids) and got[i].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
