"""The queries of this subpackage and the SQL that gives their rows, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, exact_dedup, langid, line_dedup, near_dedup, pieces, pii, repair, secrets, sharding, toxicity, trie

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    """Place of a public tokenizer's file on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def fold(parts: int) -> Column:
    """The fold of a document: crc32 of its id as text."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kneser-Ney character models, fitted on the folds 0, 1 and 3."""
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(fold(4) != 2))
    return langid.identify(docs, model).withColumn("held_out", fold(4) == 2)


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digest(secrets.find_secrets(table(spark, sf_dir, "documents")))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the lines that stand on ten sites or more."""
    clean = line_dedup.drop_spread_lines(table(spark, sf_dir, "documents"))
    return clean.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(table(spark, sf_dir, "documents"), percent=85).drop("th", "n_links", "chosen")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = sharding.kd_shards(table(spark, sf_dir, "documents"), n_shards=8)
    return shards.withColumn("law", F.lit("bytes")).withColumn("grown_shard", F.lit(None).cast("int"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digest(table(spark, sf_dir, "documents"), vocabulary_path())


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digest(pii.find_pii(table(spark, sf_dir, "documents")))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents")).drop("th")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the field fitted on the folds 1 to 4 of the labels."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    field = toxicity.train(docs, labels.where(fold(5) != 0))
    scored = toxicity.score_documents(docs, field)
    spans = F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"))), ",")
    return scored.select("doc_id", (fold(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), spans.alias("spans"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations with planted faults, repaired by the cheapest edits."""
    conversations = table(spark, sf_dir, "conversations")
    return repair.repair(repair.damage(conversations), conversations.select("conv_id")).withColumnRenamed("conv", "conv_id")


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.piece_digest(table(spark, sf_dir, "documents"), vocabulary_path("piece_bpe_32k.model"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of conversations that begin with turns lent by the first of their hundred."""
    prints = trie.turn_prints(table(spark, sf_dir, "conversations"))
    return trie.prefix_trie(trie.share_heads(prints), prints.select("conv"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_language_id, op2_secrets, op3_line_dedup, op4_near_dedup, op5_sharding, op6_bpe, op7_pii, op8_exact_dedup, op9_toxicity, op10_decontamination, op11_conversation_repair, op12_sentencepiece, op13_prefix_trie)
}

SQL: dict[str, str] = {
    "op3_line_dedup": r"""
WITH lines AS (SELECT DISTINCT source, UNNEST(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
wide AS (SELECT line FROM lines WHERE line <> '' GROUP BY line HAVING count(DISTINCT coalesce(source, chr(1))) >= 10),
drops AS (SELECT list(line) AS l FROM wide),
parts AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS p, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: NOT list_contains(coalesce(l, []), x)) AS c FROM documents, drops)
SELECT doc_id, len(p)::BIGINT AS n_lines, (len(p) - len(c))::BIGINT AS n_removed, sha256(coalesce(array_to_string(c, chr(10)), '')) AS text_sha256 FROM parts""",
    "op4_near_dedup": r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, len(s)::BIGINT AS n FROM s), u AS (SELECT doc_id, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM u a JOIN u b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS c FROM n UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id)
SELECT doc_id, n AS n_shingles, min(c) AS component_id, doc_id = min(c) AS kept FROM r JOIN n USING (doc_id) GROUP BY doc_id, n""",
    "op8_exact_dedup": r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(translate(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS text_sha256 FROM documents),
g AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g""",
}
