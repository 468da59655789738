"""Secret scan with corpus-wide ownership frequency.

Patterns propose candidates in every text.  Their values' hashes are aggregated by distinct
repositories and owners: a value that many owners hold is a copied example, one that few hold and that
looks random is a live credential.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, stash, text_of
from .spans import count_kind, ordered, spans, written

#: The formats searched for.  The first three are the base kinds.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = ["assign", "access", "hex", "github", "jwt", "pem"]
GITHUB = r"gh[pousr]_[A-Za-z0-9]{36,255}+"
JWT = r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"
PEM = r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"
PLACEHOLDER = r"(?i)example|sample|dummy|changeme|placeholder|your|xxxx|\*\*\*|1234567|abcdef"


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "doc_id", owner_col: str = "source", copied_owners: int = 3, min_symbols: int = 8) -> DataFrame:
    """One row per input row: doc_id, base (array of s, e, k, v, b), found (base and added kinds), n_live,
    n_copied, n_values.

    A value is copied when copied_owners owners or more hold it; otherwise it is live when it has
    min_symbols different characters and no placeholder word.  Null text is empty; a null owner or
    repository counts as one of its own.  Repeated rows are rows.  An empty table gives no rows.
    """
    text = F.col("text")
    base = docs.select(
        column(id_col).alias("doc_id"), text_of(text_col).alias("text"), F.monotonically_increasing_id().alias("rid"),
        F.xxhash64(F.coalesce(column(repo_col).cast("string"), F.lit("\x00"))).alias("repo"), F.xxhash64(F.coalesce(column(owner_col).cast("string"), F.lit("\x00"))).alias("owner"),
    )
    arrays = [
        spans(text, ASSIGN, 0, lambda v: F.char_length(F.regexp_extract(v, ASSIGN, 1)) >= 6),
        spans(text, r"AKIA[A-Z0-9]{16,}+", 1),
        spans(text, r"[0-9a-f]{24,}+", 2),
        spans(text, GITHUB, 3),
        spans(text, JWT, 4),
        spans(text, PEM, 5),
    ]
    scanned = stash(base.select("doc_id", "rid", "repo", "owner", ordered(*arrays).alias("found")), "secrets")
    value = F.when(F.col("x.k") == 0, F.regexp_extract("x.v", ASSIGN, 1)).otherwise(F.col("x.v"))
    held = scanned.select("rid", "repo", "owner", F.explode("found").alias("x")).where("x.k <> 5").select("rid", "repo", "owner", F.xxhash64(value).alias("h"), (~value.rlike(PLACEHOLDER) & (F.size(F.array_distinct(F.split(value, ""))) >= min_symbols)).alias("random"))
    held = stash(held.distinct(), "held")
    by_owner = held.groupBy("h", "owner").agg(F.count("*").alias("n"))
    owners = by_owner.groupBy("h").agg(F.count("*").alias("owners"))
    repos = held.groupBy("h", "repo").agg(F.count("*").alias("n")).groupBy("h").agg(F.count("*").alias("repos"))
    spread = stash(owners.join(repos, "h"), "owners")
    judged = held.join(spread, "h").groupBy("rid").agg(
        F.count("*").alias("n_values"), F.count_if(F.col("owners") >= copied_owners).alias("n_copied"), F.count_if((F.col("owners") < copied_owners) & F.col("random")).alias("n_live"), F.max("owners").alias("max_owners"), F.max("repos").alias("max_repos"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return scanned.join(judged, "rid", "left").select("doc_id", F.filter("found", lambda x: x["k"] < 3).alias("base"), "found", *map(zero, ("n_values", "n_copied", "n_live", "max_owners", "max_repos")))


def secret_digest(found: DataFrame) -> DataFrame:
    """Counts and span lists of find_secrets(), one row for each of its rows; no spans give zeros, the digest of nothing and an empty list."""
    base = F.col("base")
    return found.select(
        "doc_id", *[count_kind(base, k).alias(f"n_{KINDS[k]}") for k in range(3)], F.sha2(written(base, KINDS), 256).alias("base_sha256"), written(F.col("found"), KINDS).alias("spans"),
        "n_values", "n_copied", "n_live", "max_owners", "max_repos",
    )
