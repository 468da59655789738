import hashlib
import math
import random
import tracemalloc

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontam, langid, sharding, toxicity
from tidemark.llm.queries import vocabulary_path

from . import cases

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary_path())


def odd_texts():
    draw = random.Random(1)
    letters = [chr(i) for i in range(0x250)] + [chr(i) for i in range(0x370, 0x400)] + [chr(i) for i in range(0x300, 0x340)] + list("’“Σςİßﬁ½²٣中あ한🙂👍🏽​\u0085\xa0　")
    texts = ["".join(draw.choice(letters) if draw.random() < 0.5 else draw.choice("abcdethe ' 's't1 ") for _ in range(draw.choice([1, 3, 10, 40]))) for _ in range(1500)]
    texts += ["".join(draw.choice("aeiounrstlhdABC'") for _ in range(n)) for n in (300, 900, 3000) for _ in range(20)]
    return [*texts, "", "<|startoftext|> hi <|endoftext|>x", "a" * 5000, "!" * 3000, "ab " * 40_000, "é" * 70_000]


def test_bpe_equals_the_library(library):
    own = bpe.vocabulary(vocabulary_path())
    for text in odd_texts():
        ids = np.frombuffer(b"".join(own.encode(text)), "<u4").tolist()
        assert ids == library.encode(text, add_special_tokens=False).ids, text[:60]
        assert own.decode_tokens(ids).decode() == library.decode(ids, skip_special_tokens=False)


def test_bpe_streams_long_pieces_in_bounded_memory():
    own = bpe.vocabulary(vocabulary_path())
    text = "".join(random.Random(2).choice("aeinrst") for _ in range(20_000))
    whole = own._merge([*own._symbols(text)])
    assert [*own.piece_tokens(own._symbols(text))] == whole
    assert 0 < own.lookahead < 1000


def test_digests_of_long_texts_need_little_memory():
    own = bpe.vocabulary(vocabulary_path())
    draw = random.Random(4)
    words = ["".join(draw.choice("aeinrstlo") for _ in range(draw.randrange(2, 9))) for _ in range(500)]
    text = " ".join(draw.choice(words) for _ in range(50_000)) * 150
    assert len(text) > 40_000_000
    bpe.digest_text(own, text[:1_000_000])
    tracemalloc.start()
    n, *_ = bpe.digest_text(own, text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n > 7_000_000 and peak < 20_000_000


def test_bpe_chunks_make_the_whole():
    own = bpe.vocabulary(vocabulary_path())
    draw = random.Random(5)
    text = "".join(draw.choice("abcé") for _ in range(90_000)) + "".join(draw.choice("ab1'!é") for _ in range(150_000)) + " the end"
    chunks = [*own.encode(text)]
    ids = np.frombuffer(b"".join(chunks), "<u4").tolist()
    n, own_sha, back = bpe.digest_text(own, text)
    assert len(chunks) > 1 and n == len(ids) and own_sha == hashlib.sha256(b"".join(chunks)).hexdigest()
    assert back == hashlib.sha256(own.decode_tokens(ids)).hexdigest()


def test_bpe_decodes_text_as_it_comes():
    own = bpe.vocabulary(vocabulary_path())
    ids = np.frombuffer(b"".join(own.encode("grüße 🙂 at noon")), "<u4").tolist()
    parts = [*own.decode_text(ids)]
    assert "".join(parts) == "grüße 🙂 at noon "


def test_bpe_frame(spark, library):
    rows = {r.doc_id: r for r in bpe.token_digest(cases.docs(spark), vocabulary_path()).collect()}
    for i, text, *_ in cases.ROWS:
        ids = library.encode(text or "", add_special_tokens=False).ids
        if i is not None:
            assert rows[i].n_tokens == len(ids)
            assert rows[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
            assert rows[i].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    full = bpe.encode_documents(cases.docs(spark, [(1, "Hello world", "en", "a"), (2, None, None, None)]), vocabulary_path()).orderBy("doc_id").collect()
    assert full[0].ids == library.encode("Hello world", add_special_tokens=False).ids and full[0].decoded == "hello world "
    assert full[1].ids == [] and full[1].decoded == ""


def test_language_id_on_held_out_documents(spark):
    from tidemark.llm.queries import op1_language_id

    rows = op1_language_id(spark, SF).where("held_out").collect()
    lang = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{SF}/documents.parquet'").fetchall())
    right = [r.lang_pred == lang[r.doc_id] for r in rows]
    assert sum(right) / len(right) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)
    assert sum(r.rejected for r in rows) <= 1


def test_language_id_edges(spark):
    docs = cases.docs(spark)
    model = langid.train(docs)
    rows = langid.identify(docs, model).collect()
    assert len(rows) == len(cases.ROWS)
    und = {r.doc_id for r in rows if r.lang_pred == "und"}
    assert und == {1, 2, 3, 14}
    assert langid.train(cases.docs(spark, [])) is None
    assert {r.lang_pred for r in langid.identify(docs, None).collect()} == {"und"}
    kept = langid.keep_identified(docs, model)
    assert kept.columns == docs.columns and kept.where("doc_id in (1, 2, 3, 14)").count() == 0


def plain_kneser_ney(grams, gram):
    """Interpolated Kneser-Ney probability of the last letter of a gram, by dictionaries; grams: for each order counts."""
    kinds = []  # continuation counts below the highest order
    for order, own in enumerate(grams[:-1], 1):
        before = {}
        for longer, n in grams[order].items():
            before[longer[1:]] = before.get(longer[1:], 0) + (n > 0)
        kinds.append({g: before[g] if before.get(g) else float(n > 0) for g, n in own.items()})
    p = 1 / (len(grams[0]) + 1)
    for order, own in enumerate([*kinds, grams[-1]], 1):
        n1, n2 = sum(v == 1 for v in own.values()), sum(v == 2 for v in own.values())
        d = min(max(n1 / max(n1 + 2 * n2, 1), 0.1), 0.9)
        above = gram[len(gram) - order : -1]
        after = [v for g, v in own.items() if g[:-1] == above]
        if sum(after) > 0:
            p = (max(own.get(gram[len(gram) - order :], 0) - d, 0) + d * sum(v > 0 for v in after) * p) / sum(after)
    return p


def test_texts_of_no_known_language_are_rejected(spark):
    from tidemark.llm.queries import table

    docs = table(spark, "/root/testdata/sf0.01", "documents")
    model = langid.train(docs)
    draw = random.Random(7)
    strange = ["zxq wvk jqx pzw qqk vxz jwq zkx " * 8, "ქართული ენა არის ერთ ერთი უძველესი ენა " * 5, "日本語の文章はここにあります " * 8, "".join(draw.choice("bcdfghjklmnpqrstvwxz ") for _ in range(400)), "аз съм тук и пиша на български език за проверка " * 4]
    plain = [(i, r.text, "", "") for i, r in enumerate(docs.where("lang is not null and length(text) > 200").select("text").limit(40).collect())]
    rows = plain + [(1000 + i, t, "", "") for i, t in enumerate(strange)]
    got = {r.doc_id: r.rejected for r in langid.identify(cases.docs(spark, rows), model).collect()}
    assert all(got[1000 + i] for i in range(len(strange)))
    assert not any(v for i, v in got.items() if i < 1000)
    kept = langid.keep_identified(cases.docs(spark, rows), model)
    assert {r.doc_id for r in kept.collect()} == set(range(len(plain)))


def test_language_sample_is_bounded(spark):
    rows = [(i, "abcdefgh " * 10, "en", "a") for i in range(50)] + [(100, "x" * 5000, "de", "a"), (101, None, "de", "a"), (102, "kurz und gut", "de", "a")]
    model = langid.train(cases.docs(spark, rows), max_chars=1000)
    # texts have room in the order of their ids; the long one has none
    keys, counts = model.tables[0]
    assert model.langs == ["de", "en"] and langid._found(keys, counts, langid._rows(np.array([[ord("x")], [ord("a")]], np.uint64)))[0].sum() == 0


def test_long_texts_are_scored_like_their_parts():
    letters = langid._letters()
    texts = ["the river runs past the old mills " * 30, "der fluss fließt an den alten mühlen vorbei " * 30]
    grams = []
    for order in range(1, langid.ORDER + 1):
        counts = {}
        for lang, text in enumerate(texts):
            c = np.concatenate((np.zeros(langid.ORDER - 1, np.uint64), langid.codes(text, letters)))
            for e in range(max(order - 1, 1), len(c)):
                if c[e] or c[e - 1]:
                    counts.setdefault(tuple(c[e - order + 1 : e + 1].tolist()), np.zeros(2))[lang] += 1
        grams.append((np.array(list(counts), np.uint64).reshape(len(counts), -1), np.array(list(counts.values()))))
    model = langid.KneserNey(["en", "de"], grams)
    # probabilities equal the plain formula; those of all letters after a context and of one unseen letter sum to one
    alphabet = grams[0][0][:, 0].tolist()
    for context in ("the", "zqx", "riv", "xth"):
        before = langid.codes(context, letters)[1:-1].tolist()
        rows = np.array([[*before, a] for a in [*alphabet, 99_999]], np.uint64)
        got = 2.0 ** -model.bits(rows)
        assert np.allclose(got.sum(0), 1.0)
        for lang in range(2):
            assert np.allclose(got[:, lang], [plain_kneser_ney([{tuple(k): v[lang] for k, v in zip(g.tolist(), n, strict=True)} for g, n in grams], tuple(r)) for r in rows.tolist()])
    one = model.entropy([langid.codes(texts[0] * 3, letters)])
    old, langid.CHUNK = langid.CHUNK, 100
    try:
        cut = model.entropy([langid.codes(texts[0] * 3, letters)])
    finally:
        langid.CHUNK = old
    assert one[0] == cut[0] and np.allclose(one[1], cut[1])


def test_toxicity_on_held_out_documents(spark):
    from tidemark.llm.queries import op9_toxicity

    big = "/root/testdata/sf0.1"
    rows = {r.doc_id: r for r in op9_toxicity(spark, big).where("held_out").collect()}
    truth = duckdb.sql(f"SELECT doc_id, toxic FROM '{big}/labels.parquet' WHERE toxic IS NOT NULL").fetchall()
    held = [(rows[i].predicted, t) for i, t in truth if i in rows]
    assert sum(p == t for p, t in held) / len(held) > 0.97
    assert sum(p for p, t in held if t) / sum(t for _, t in held) > 0.85


def test_toxicity_query_equals_plain_passes(spark):
    """Every document's score by whole forward and backward passes over all its tokens, and the same features."""
    from tidemark.llm.queries import fold, op9_toxicity, table

    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    field = toxicity.train(docs, labels.where(fold(5) != 0))
    got = {r.doc_id: r.score for r in op9_toxicity(spark, SF).collect()}
    assert field.weights and (field.stay, field.enter, field.bias) != (0.5, 0.0, -5.0)
    clean = np.array([[1.0, math.exp(field.enter + field.bias)], [1.0, math.exp(field.stay + field.bias)]])
    seen = 0
    for r in docs.collect():
        words = toxicity.WORD.findall(r.text or "")
        if len(words) > 2000:
            continue
        e = [min(sum(field.weights.get(f, 0.0) for f in toxicity.features(w)), 30.0) for w in words]
        ahead, back = [np.array([1.0, 0.0])], [np.ones(2)]
        for x in e:
            v = ahead[-1] @ (clean * [1.0, math.exp(x)])
            ahead.append(v / v.sum())
        for x in reversed(e):
            v = (clean * [1.0, math.exp(x)]) @ back[-1]
            back.append(v / v.sum())
        both = [a * b for a, b in zip(ahead[1:], reversed(back[:-1]), strict=True)]
        p = [b[1] / b.sum() for b, w in zip(both, words, strict=True) if any(f in field.weights for f in toxicity.features(w))]
        z = field.scale @ [1.0, sum(p), max(p, default=0.0), math.log1p(100 * sum(p) / (len(words) + 20))]
        assert got[r.doc_id] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-6)
        seen += bool(p)
    assert seen > 50


def test_toxicity_spans_and_edges(spark):
    bad, good = "you utter gronk of a man", "you fine friend of a man"
    texts, labels = [f"{bad} number {i}" for i in range(40)] + [f"{good} number {i}" for i in range(200)], [1] * 40 + [0] * 200
    field = toxicity.fit(texts, labels)
    got = {r.doc_id: r for r in toxicity.score_documents(cases.docs(spark, [(100, "Well, GRONK is here", "en", "a"), *cases.ROWS]), field).collect()}
    assert got[100].score > 0.5 and [(s.start, s.end) for s in got[100].spans] == [(6, 11)]
    assert all(0 <= r.score < 0.5 and not r.spans for i, r in got.items() if i != 100)
    assert toxicity.fit([], []).weights == {} and toxicity.fit(["a"], [1]).weights == {}
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.train(cases.docs(spark), labels).weights == {}


def test_toxicity_sample_is_bounded_before_the_driver(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, labels: seen.append((texts, labels)))
    rows = [(1, "a" * 9, "en", "a"), (2, "b" * 99, "en", "a"), (3, None, "en", "a"), (4, "dd", "en", "a"), (4, "dd", "en", "a"), (5, "not labelled", "en", "a")]
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, 0), (4, 0), (4, 1), (6, 1), (None, 1), (5, None)], "doc_id long, toxic int")
    toxicity.train(cases.docs(spark, rows), labels, max_chars=13)
    toxicity.train(cases.docs(spark, rows), labels, max_chars=12)
    # a text that has no room is left out; the higher of two labels counts; repeated rows stay rows
    assert seen == [(["a" * 9, "", "dd", "dd"], [0, 0, 1, 1]), (["a" * 9, ""], [0, 0])]


def test_marginals_equal_enumeration():
    field = toxicity.ToxicField({"=x": 2.0}, 0.7, -0.3, -1.0)
    words = ["a", "x", "a", "a", "x", "b"]
    e = [field.emission(w) for w in words]
    total, on = 0.0, [0.0] * len(words)
    for code in range(2 ** len(words)):
        states = [code >> i & 1 for i in range(len(words))]
        s, before = 0.0, 0
        for z, x in zip(states, e, strict=True):
            if z:
                s += (field.stay if before else field.enter) + field.bias + (x or 0.0)
            before = z
        total += np.exp(s)
        for i, z in enumerate(states):
            on[i] += z * np.exp(s)
    marked, size = field.marked(" ".join(words))
    assert np.allclose(field.marginals(marked, size), [on[i] / total for i, x in enumerate(e) if x is not None])


def planted_chain(stay, enter, bias, weights, n, seed):
    """Sequences whose states follow the chain given; marked tokens have one feature each."""
    draw, out, names = random.Random(seed), [], list(weights)
    for _ in range(n):
        marks = [(i, draw.choice(names)) for i in range(draw.randrange(5, 60)) if draw.random() < 0.4]
        size = 60
        e = dict(marks)
        behind = [(1.0, 1.0)] * (size + 1)
        for i in reversed(range(size)):
            on = [math.exp(x + bias + (weights[e[i]] if i in e else 0)) * behind[i + 1][1] for x in (enter, stay)]
            both = [behind[i + 1][0] + x for x in on]
            behind[i] = (both[0] / sum(both), both[1] / sum(both))
        states, z = {}, 0
        for i in range(size):
            on = math.exp((stay if z else enter) + bias + (weights[e[i]] if i in e else 0)) * behind[i + 1][1]
            z = int(draw.random() < on / (on + behind[i + 1][0]))
            states[i] = z
        out.append(([(i, [f]) for i, f in marks], size, [states[i] for i, _ in marks]))
    return out


def test_the_chain_recovers_planted_parameters():
    weights = {"f0": 6.0, "f1": 5.0, "f2": 8.0}
    w, (stay, enter, bias) = toxicity.fit_chain(planted_chain(2.0, -0.5, -7.5, weights, 2500, 1), dict.fromkeys(weights, 0.5), (0.5, 0.0, -5.0), 400, 0.3, 0.0)
    # bias and weights may trade places on tokens that all have one feature; what they sum to may not
    for f, x in weights.items():
        assert w[f] + bias + enter == pytest.approx(x - 8.0, abs=0.3)
    assert stay - enter == pytest.approx(2.5, abs=0.4)
    assert abs(bias + 5.0) > 0.3


def test_batched_passes_equal_the_plain_ones():
    tokens = planted_chain(0.7, -0.3, -2.0, {"a": 1.0, "b": 2.5}, 30, 3) + [([], 7, []), ([], 0, [])]
    batch, w = toxicity._Batch(tokens, ["a", "b"]), np.array([1.0, 2.5])
    total, got = batch.run(batch.emissions(w), 0.7, -0.3, -2.0, back=True)
    field = toxicity.ToxicField({}, 0.7, -0.3, -2.0)
    want, sums = [], 0.0
    for marks, size, _ in tokens:
        e = [(i, {"a": 1.0, "b": 2.5}[f[0]]) for i, f in marks]
        want += field.marginals(e, size)
        m, x = np.array([1.0, 0.0]), dict(e)
        for i in range(size):
            m = m @ np.array([[1.0, math.exp(-2.3 + x.get(i, 0.0))], [1.0, math.exp(-1.3 + x.get(i, 0.0))]])
        sums += math.log(m.sum())
    assert sorted(got.tolist()) == pytest.approx(sorted(want)) and total == pytest.approx(sums)


def plain_alignment(a, b):
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b, 1):
            new.append(max(0, row[j - 1] + (2 if x == y else -1), row[j] - 1, new[-1] - 1))
        best, row = max(best, *new), new
    return best


def test_alignment_equals_the_plain_table():
    draw = random.Random(4)
    for _ in range(200):
        a, b = ([draw.randrange(5) for _ in range(draw.randrange(1, 20))] for _ in range(2))
        assert decontam.smith_waterman(np.array(a), np.array(b))[0] == plain_alignment(a, b)


def test_rare_seeds_are_measured_against_their_own_item(spark):
    draw = random.Random(8)
    items = [(i, draw.randrange(1, 30)) for i in range(40)]
    grams = [(i, n, size, at, 1000 * i + 100 * size + at) for i, n in items for size in ((3, 4) if n >= 3 else (n,)) for at in range(n - size + 1)]
    counts = {g[4]: draw.choice([1, 5, 60, 3000]) for g in grams if draw.random() < 0.8}
    got = decontam.rare_seeds(spark.createDataFrame(grams, "item long, n int, size int, at int, h long"), spark.createDataFrame([*counts.items()], "h long, df long"), 2, 50)
    want = set()
    for i, n in items:
        own = {(size, at): h for k, _, size, at, h in grams if k == i and h in counts}
        met = sorted(counts[h] for (size, _), h in own.items() if size == 3)
        limit = max(50, 2 * met[-(-len(met) // 4) - 1]) if met else 0
        for (size, at), h in own.items():
            common = (3, at) in own and counts[own[3, at]] > limit and n > 3
            if size < 3 or (size == 3 and not common) or (size == 4 and common):
                want.add((i, at, h))
    assert {tuple(r) for r in got.collect()} == want and any(h % 1000 // 100 == 4 for *_, h in want)


def test_short_items_are_found_whole(spark):
    docs = cases.docs(spark, [(1, "the Quick-brown, fox", "en", "a"), (2, "brown quick", "en", "a"), (3, "a zebra", "en", "a"), (4, "the quick red fox", "en", "a")])
    bench = spark.createDataFrame([(1, "quick brown"), (2, "zebra"), (3, ""), (4, None), (5, "quick red fox")], "item_id long, text string")
    assert {(r.doc_id, r.item_id, r.score, r.start_word, r.end_word) for r in decontam.find_leaks(docs, bench).collect()} == {(1, 1, 1.0, 1, 3), (3, 2, 1.0, 1, 2), (4, 5, 1.0, 1, 4)}
    assert {r.doc_id for r in decontam.drop_leaks(docs, bench).collect()} == {2}


def test_leaks_whole_edited_and_clean(spark):
    item = "Which river runs through the capital of the northern province and feeds the seven mills beside the cathedral square today"
    words = item.split()
    edited = " ".join("other" if i % 5 == 4 else w for i, w in enumerate(words))
    filler = " ".join(cases.WORDS * 3)
    rows = [(100, f"{filler} {item.upper()} {filler}", "en", "a"), (101, f"{filler} {edited} {filler}", "en", "a"), (102, filler, "en", "a"), (103, " ".join(words[:5]), "en", "a"), *[(200 + i, f"{item} {i}", "en", "a") for i in range(80)]]
    bench = spark.createDataFrame([(1, item), (1, item), (2, "too short"), (3, None), (4, "")], "item_id long, text string")
    got = decontam.find_leaks(cases.docs(spark, rows + cases.ROWS), bench).collect()
    by = {r.doc_id: r for r in got}
    assert set(by) == {100, 101, *range(200, 280)} and by[100].score == 1.0 and 0.4 <= by[101].score < 1
    assert (by[100].start_word, by[100].end_word) == (75, 75 + len(words))
    docs = cases.docs(spark, rows + cases.ROWS)
    blocks = decontam.drop_leaks(docs, bench, most_grams=10)
    assert blocks.count() == docs.count() - 82 and blocks.columns == docs.columns
    assert decontam.find_leaks(docs, bench.limit(0)).count() == 0


def test_leaks_of_many_equally_changed_copies(spark):
    # no seed is rare here: each stands in 300 documents, and many of the items' trigrams in none
    items = ["Which river runs through the capital of the northern province and feeds the seven mills beside the cathedral square today", "how many wooden boats crossed the frozen lake before the old harbour master closed both gates for that winter"]
    edited = " ".join("other" if i % 5 == 4 else w for i, w in enumerate(items[0].split()))
    short = " ".join(items[1].split()[:11])
    filler = " ".join(cases.WORDS * 3)
    rows = [(i, f"{filler} {edited if i < 300 else short} {i} {filler}", "en", "a") for i in range(600)] + [(1000, filler, "en", "a")]
    docs, bench = cases.docs(spark, rows), spark.createDataFrame([*enumerate(items)], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontam.find_leaks(docs, bench).collect()} == {(i, i // 300) for i in range(600)}
    assert [r.doc_id for r in decontam.drop_leaks(docs, bench).collect()] == [1000]


def test_leaks_equal_aligning_everything(spark):
    """Every item aligned with every document by the plain table; the seeds may miss only copies without any seed left."""
    draw = random.Random(11)
    vocabulary = [f"{a}{b}" for a in "bcdfglmnprst" for b in ("an", "er", "il", "or", "um", "eth", "ing", "as")]
    items = {k: [draw.choice(vocabulary) for _ in range(draw.randrange(8, 40))] for k in range(25)}
    rows = []
    for i in range(160):
        words = [draw.choice(vocabulary) for _ in range(draw.randrange(0, 80))]
        if i % 2:  # a copy with words changed, left out and put in, at any rate of edits
            rate, copy = draw.choice([0, 0.05, 0.15, 0.25, 0.35]), []
            for w in items[i % 25]:
                x = draw.random()
                copy += [w] if x > rate else [[], [draw.choice(vocabulary)], [w, draw.choice(vocabulary)]][draw.randrange(3)]
            at = draw.randrange(len(words) + 1)
            words[at:at] = copy
        rows.append((i, " ".join(words), "en", "a"))
    docs, bench = cases.docs(spark, rows), spark.createDataFrame([(k, " ".join(v)) for k, v in items.items()], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in decontam.find_leaks(docs, bench).collect()}
    want, seedless = {}, set()
    for i, text, *_ in rows:
        words = text.split()
        grams = {tuple(words[k : k + 3]) for k in range(len(words) - 2)}
        for k, item in items.items():
            best = plain_alignment(item, words)
            if best >= 0.4 * 2 * len(item):
                want[i, k] = best / (2 * len(item))
                if not grams & {tuple(item[j : j + 3]) for j in range(len(item) - 2)}:
                    seedless.add((i, k))
    assert set(got) <= set(want)
    found = len(got) / len(want)
    assert found >= 0.98 and set(want) - set(got) <= seedless
    assert sum(abs(got[p] - want[p]) < 1e-9 for p in got) / len(got) > 0.97
    # a benchmark too large for the table of n-grams changes nothing
    assert {(r.doc_id, r.item_id): r.score for r in decontam.find_leaks(docs, bench, most_grams=100).collect()} == got
    assert {r.doc_id for r in decontam.drop_leaks(docs, bench).collect()} == {r[0] for r in rows} - {i for i, _ in got}


def test_shards(spark):
    rows = [(i, "w" * (i * 37 % 500), "en", "a") for i in range(2000)] + [(3000 + i, "same text again and again", "en", "b") for i in range(700)] + cases.ROWS[:3]
    got = sharding.kd_shards(cases.docs(spark, rows), rows_per_slot_block=300).collect()
    assert len(got) == len(rows)
    sizes = [sum(r["size"] for r in got if r.shard == k) for k in range(8)]
    assert max(sizes) - min(sizes) < 0.03 * sum(sizes)
    for k in range(8):
        slots = sorted(r.slot for r in got if r.shard == k)
        assert slots == list(range(len(slots)))
    assert sharding.kd_shards(cases.docs(spark, [])).count() == 0
    few = sharding.kd_shards(cases.docs(spark, rows), target_bytes=100_000).select("shard").distinct().count()
    total = sum(r["size"] for r in got)
    assert few == -(-total // 100_000)


def plain_shards(rows, n_shards, tolerance=0.005):
    """shard of each row (dims, hash, order, size) by sorting each node whole: a k-d tree in plain Python."""
    low = [min(r[0][i] for r in rows) for i in range(3)]
    span = [max(max(r[0][i] for r in rows) - low[i], 1e-12) for i in range(3)]
    top = 2**sharding.DIM_BITS - 1
    keyed = [([math.floor((r[0][i] - low[i]) / span[i] * top) for i in range(3)], r[1] % 2**sharding.HASH_BITS, r[2], r[3], k) for k, r in enumerate(rows)]
    out = {}

    def split(own, share, first):
        if share == 1 or not own:
            out.update({r[4]: first for r in own})
            return
        wide = [max(r[0][i] for r in own) - min(r[0][i] for r in own) for i in range(3)]
        axis = wide.index(max(wide))
        total, half = sum(r[3] for r in own), share // 2
        aim, before, sizes = total * half / share, 0, {}
        for r in own:
            sizes[r[0][axis], r[1]] = sizes.get((r[0][axis], r[1]), 0) + r[3]
        for key in sorted(sizes):
            if before + sizes[key] >= aim:
                break
            before += sizes[key]
        part = (aim - before) / sizes[key]
        left = [r for r in own if (r[0][axis], r[1]) < key]
        on = sorted((r for r in own if (r[0][axis], r[1]) == key), key=lambda r: r[2])
        if abs((part >= 0.5) - part) * sizes[key] <= tolerance * total:
            left += on if part >= 0.5 else []
        else:
            for r in on:
                if before + r[3] < aim:
                    left.append(r)
                    before += r[3]
                else:
                    left += [r] if aim - before >= r[3] / 2 else []
                    break
        taken = {r[4] for r in left}
        split(left, half, first)
        split([r for r in own if r[4] not in taken], share - half, first + half)

    split(keyed, n_shards, 0)
    return out


@pytest.mark.parametrize("n_shards", [8, 5, 1])
def test_shards_equal_a_plain_tree(spark, n_shards):
    draw = random.Random(6)
    rows = [(i, "w" * draw.randrange(300) + "é" * draw.randrange(3) + ("\n" if i % 5 == 0 else "") + "x" * (i % 7), "en", "a") for i in range(700)]
    rows += [(1000 + i, "the same text again", "en", "a") for i in range(400)] + [(2000, "repeated row", "en", "a")] * 5 + [(3000, None, "en", "a"), (3001, "", "en", "a")]
    docs = cases.docs(spark, rows)
    text = F.coalesce("text", F.lit(""))
    known = docs.select("doc_id", F.xxhash64(text).alias("th"), F.lit(0).alias("rid")).withColumn("r", sharding.cut_order()).distinct().collect()
    known = {r.doc_id: (r.th, r.r) for r in known}
    plain = [((len((t or "").encode()) + 1, len((t or "").encode()) / max(len(t or ""), 1), (t or "").find("\n") + 1), *known[i], len((t or "").encode()) + 1) for i, t, *_ in rows]
    want = plain_shards(plain, n_shards)
    got = sorted((r.doc_id, r.shard) for r in sharding.kd_shards(docs, n_shards=n_shards).collect())
    assert got == sorted((rows[k][0], s) for k, s in want.items())
    # the layout of the files decides nothing
    assert sorted((r.doc_id, r.shard) for r in sharding.kd_shards(docs.repartition(7, "text"), n_shards=n_shards).collect()) == got


@pytest.mark.parametrize("copies", [45, 170, 600, 2000])
def test_repeated_rows_are_split(spark, copies):
    """One row with a tenth, a third, six tenths or nearly all of the bytes: shards stay equal but for a row and the tolerance of each cut."""
    draw = random.Random(8)
    rows = [(i, "".join(draw.choice("abcdé \n") for _ in range(draw.randrange(20, 60))), "en", "a") for i in range(400)] + [(5000, "z" * 39, "en", "a")] * copies
    got = sharding.kd_shards(cases.docs(spark, rows)).collect()
    sizes = [sum(r["size"] for r in got if r.shard == k) for k in range(8)]
    assert len(got) == len(rows) and max(sizes) - min(sizes) <= 0.03 * sum(sizes) / 8 + 2 * 130, sizes
    assert all(sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got))) for k in range(8))


def test_thousands_of_leaves(spark):
    docs = spark.range(40_000).select(F.col("id").alias("doc_id"), F.concat(F.sha2(F.col("id").cast("string"), 256), F.repeat(F.lit("x"), (F.col("id") % 97).cast("int"))).alias("text"))
    got = sharding.kd_shards(docs, n_shards=4096).groupBy("shard").agg(F.sum("size").alias("w"), F.count("*").alias("n"), F.max("slot").alias("m")).collect()
    mean = sum(r.w for r in got) / 4096
    assert len(got) == 4096 and max(r.w for r in got) < 2 * mean and all(r.m == r.n - 1 for r in got)
