"""Licence scan by canonical digest.

A text is brought to a canonical form: lower case, copyright lines dropped, equivalent spellings and
quotation marks unified, every run of other characters than letters and digits one space. The SHA-256 of
the whole canonical text is hash-joined to the digests of the known licence texts, which pass through
the same expressions. DataFrame functions only.

Defined results: null texts and texts whose canonical form is empty match nothing; licence_id is null
where nothing matches. Repeated rows give repeated results; extra columns are ignored; texts are
read whole, however long; an empty table gives no rows. Two known texts with the same digest give the id that
sorts first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import spread_table
from .license_texts import KNOWN

# Lines that only claim copyright, and spellings that licence matching treats as one.
COPYRIGHT_LINE = r"(^|\n)[ \t*#/;.-]*(copyright|\(c\)|©)[^\n]*"
RIGHTS_LINE = r"(^|\n)[ \t*#/;.-]*all rights reserved[ \t.]*"
SPELLINGS = (
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("authorisation", "authorization"), ("authorised", "authorized"),
    ("behaviour", "behavior"), ("centre", "center"), ("favour", "favor"), ("fulfil ", "fulfill "), ("initialise", "initialize"),
    ("licence", "license"), ("merchantibility", "merchantability"), ("non commercial", "noncommercial"), ("organisation", "organization"),
    ("percent", "per cent"), ("recognise", "recognize"), ("sub license", "sublicense"), ("utilisation", "utilization"),
    ("whilst", "while"), ("wilful", "willful"), ("https ", "http "),
)


def canonical(text: Column) -> Column:
    """The form in which licence texts are compared."""
    lines = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), COPYRIGHT_LINE, "\n")
    spaced = F.regexp_replace(F.regexp_replace(lines, RIGHTS_LINE, "\n"), r"[^\p{L}\p{N}]+", " ")
    for odd, usual in SPELLINGS:
        spaced = F.replace(spaced, F.lit(odd), F.lit(usual))
    return F.trim(spaced)


def digest(text: Column) -> Column:
    """SHA-256 of the canonical form in hex; null where that is empty."""
    return F.when(F.length(canonical(text)) > 0, F.sha2(canonical(text), 256))


def known_digests(spark: SparkSession, known: list[tuple[str, str]]) -> DataFrame:
    """(digest, licence_id) of licence texts."""
    texts = spark.createDataFrame(known, "licence_id string, licence_text string")
    return texts.groupBy(digest(F.col("licence_text")).alias("digest")).agg(F.min("licence_id").alias("licence_id"))


def scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, digest and licence_id of each row of docs(doc_id, text).

    `known` is a list kept with the code, so Spark may broadcast it; documents are not shuffled then.
    """
    canon = docs.select("doc_id", canonical(F.col("text")).alias("_canonical"))
    digests = canon.select("doc_id", F.when(F.length("_canonical") > 0, F.sha2("_canonical", 256)).alias("digest"))
    return digests.join(F.broadcast(known), "digest", "left").select("doc_id", "digest", "licence_id")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spread_table(spark, sf_dir, "documents", "doc_id", "text"), known_digests(spark, KNOWN))


def _sql() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    form = f"regexp_replace(lower(coalesce(body, '')), {quoted(COPYRIGHT_LINE)}, chr(10), 'g')"
    form = f"regexp_replace({form}, {quoted(RIGHTS_LINE)}, chr(10), 'g')"
    form = f"regexp_replace({form}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')"
    for odd, usual in SPELLINGS:
        form = f"replace({form}, {quoted(odd)}, {quoted(usual)})"
    known = ", ".join(f"({quoted(name)}, {quoted(text)})" for name, text in KNOWN)
    return f"""
WITH known(licence_id, body) AS (VALUES {known}),
known_digest AS (SELECT sha256(trim({form})) AS digest, min(licence_id) AS licence_id FROM known GROUP BY 1),
canon AS (SELECT doc_id, trim({form}) AS canon FROM (SELECT doc_id, text AS body FROM documents)),
digests AS (SELECT doc_id, CASE WHEN length(canon) > 0 THEN sha256(canon) END AS digest FROM canon)
SELECT doc_id, digest, licence_id FROM digests LEFT JOIN known_digest USING (digest)
"""


OP8_SQL = _sql()
