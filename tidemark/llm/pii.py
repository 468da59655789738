"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

The patterns are possessive and may start only where a run of their characters starts (or where the
last match ended), so their work is linear in the text and finds what the plain patterns find.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, text_of
from .spans import count_kind, ordered, spans, written

#: Kinds in order, their patterns, and their context words.  The first four are the base kinds.
KINDS = ["email", "ip", "card", "phone", "iban"]
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9]){13,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}+|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)(?![A-Za-z0-9])"
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
CONTEXT = [r"mail|contact|write|address", r"\bip\b|host|server|address|login", r"card|visa|master|payment|credit|amex", r"phone|call|tel|mobile|fax|whatsapp", r"iban|bank|account|transfer|konto"]
PRIOR, BONUS = [0.8, 0.6, 0.8, 0.5, 0.9], 0.2


def digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def luhn(v: Column) -> Column:
    """Whether the digits of v pass the Luhn check."""
    n = F.reverse(digits(v))

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(n, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return acc + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.char_length(n)), F.lit(0), add) % 10 == 0


def mod97(v: Column) -> Column:
    """Whether v without spaces is an IBAN whose remainder is 1."""
    plain = F.regexp_replace(v, " ", "")
    turned = F.concat(F.substring(plain, F.lit(5), F.char_length(plain)), F.substring(plain, 1, 4))

    def add(acc: Column, c: Column) -> Column:
        letter = F.ascii(c) - 55
        return F.when(c.rlike("[0-9]"), (acc * 10 + F.ascii(c) - 48) % 97).otherwise((acc * 100 + letter) % 97)

    return F.char_length(plain).between(15, 34) & (F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), add) == 1)


def is_card(v: Column) -> Column:
    return F.when(F.char_length(digits(v)).between(14, 19), luhn(v)).otherwise(F.lit(False))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 40) -> DataFrame:
    """One row per input row: doc_id, found (array of s, e, k, v, b), scores (one per span, 0 to 1).

    A span's score is its kind's prior, raised when a context word stands within window code points before
    it.  Null and empty texts have no spans; an empty table gives no rows.
    """
    text = F.col("text")
    arrays = [
        spans(text, EMAIL, 0, window=window),
        spans(text, IP, 1, lambda v: v.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$"), window),
        spans(text, CARD, 2, is_card, window),
        spans(text, PHONE, 3, lambda v: F.char_length(digits(v)).between(10, 15), window),
        spans(text, IBAN, 4, mod97, window),
    ]
    found = docs.select(column(id_col).alias("doc_id"), text_of(text_col).alias("text")).select("doc_id", ordered(*arrays).alias("found"))

    def score(x: Column) -> Column:
        before = F.lower(x["b"])
        near = F.coalesce(*[F.when((x["k"] == k) & before.rlike(words), F.lit(BONUS)) for k, words in enumerate(CONTEXT)], F.lit(0.0))
        return F.least(F.element_at(F.array(*map(F.lit, PRIOR)), x["k"] + 1) + near, F.lit(1.0))

    return found.select("doc_id", "found", F.transform("found", score).alias("scores"))


def pii_digest(found: DataFrame) -> DataFrame:
    """Counts and span lists of find_pii(), one row for each of its rows; no spans give zeros, the digest of nothing and empty lists."""
    base = F.filter("found", lambda x: x["k"] < 4)
    return found.select(
        "doc_id", *[count_kind(base, k).alias(f"n_{KINDS[k]}") for k in range(4)], F.sha2(written(base, KINDS), 256).alias("base_sha256"), written(F.col("found"), KINDS).alias("spans"),
        F.array_join(F.transform("scores", lambda x: F.format_string("%.2f", x)), ",").alias("scores"),
    )
