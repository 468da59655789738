import hashlib
import random

import pytest
import sentencepiece

from tidemark.llm import pieces
from tidemark.llm.queries import QUERIES, vocabulary_path

from . import cases

PATH = vocabulary_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def agree(own, library, text):
    ids = library.encode(text)
    assert own.encode(text) == ids and own.decode(ids) == library.decode(ids), text[:80]
    assert own.digest(text) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()), text[:80]


def test_equals_library(library, monkeypatch):
    own, draw = pieces.PieceBpe.load(PATH), random.Random(1)
    letters = "abcdeinrst  \n▁éЖ日🙂.,'0129-_<>/\"(){}=\t\x00²\u0301\u200b"
    odd = ["", "  a b ", "▁x", " ", "\n", "<s>a</s>", "<0x41>", "x" * 20_000, " " * 5000, "日本語" * 3000, "▁▁ ▁x ▁", "a" * 33 + " " * 41 + "b"]
    made = ["".join(draw.choice(letters) for _ in range(draw.randrange(40))) for _ in range(2000)]
    joined = ["".join(draw.choice(list(own.pieces)).replace("▁", " ") for _ in range(draw.randrange(1, 12))) for _ in range(2000)]
    for text in [*odd, *made, *joined, cases.LONG]:
        agree(own, library, text)
    monkeypatch.setattr(pieces, "SLICE", 16)
    monkeypatch.setattr(pieces, "TABLE", 50)
    monkeypatch.setattr(pieces, "PAIRS", 50)
    for text in [*odd[:7], *made[:500], cases.LONG[:5000]]:
        agree(own, library, text)


def test_decodes_any_ids(library):
    own, draw = pieces.model(PATH), random.Random(2)
    for _ in range(1500):
        ids = [draw.randrange(32_000) if draw.random() < 0.5 else draw.randrange(300) for _ in range(draw.randrange(12))]
        assert own.decode(ids) == library.decode(ids), ids


def test_backtracks_where_longest_matches_fail():
    """Small vocabularies in which the longest piece is often wrong: equal to the merges themselves."""
    draw = random.Random(5)
    for _ in range(60):
        parts = {"a", "b", "c"} | {"".join(draw.choice("abc") for _ in range(draw.randrange(2, 6))) for _ in range(12)}
        ranked = draw.sample(sorted(parts), len(parts))
        own = pieces.PieceBpe({p: (i, -float(i)) for i, p in enumerate(ranked)}, None, 99, prefix=False)
        for _ in range(60):
            word = "".join(draw.choice("abc") for _ in range(draw.randrange(1, 30)))
            assert own.tokens(word) == own.merge(word), (ranked, word)


def test_documents(spark, library):
    rows = pieces.encode_pieces(cases.docs(spark), PATH).collect()
    assert len(rows) == len(cases.ROWS) and all(r.decoded == library.decode(r.ids) for r in rows)
    assert pieces.piece_digest(cases.docs(spark, []), PATH).count() == 0


def test_query_12_equals_library(spark, library):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = QUERIES["op12_sentencepiece"](spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
