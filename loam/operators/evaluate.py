"""Retrieval metrics, faithfulness, answer checks and the golden-set gate."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loam.functions.text import claim_sentences, content_words


def require_relevant(relevant: DataFrame) -> DataFrame:
    """relevant(case_id, url), or an error when it is evaluated on a row without a URL."""
    return relevant.withColumn("url", F.coalesce("url", F.raise_error(F.lit("a case needs at least one relevant URL")).cast("string")))


def distinct_hits(returned: DataFrame, relevant: DataFrame) -> DataFrame:
    """(case_id, place, hit): distinct URLs of returned(case_id, rank, url) in the order of their first rank.

    Only cases with relevant URLs (case_id, url) count.
    """
    first = returned.groupBy("case_id", "url").agg(F.min("rank").alias("rank"))
    cases = relevant.select("case_id").distinct()
    flagged = first.join(cases, "case_id", "left_semi").join(relevant.select("case_id", "url", F.lit(True).alias("hit")).distinct(), ["case_id", "url"], "left")
    place = F.row_number().over(Window.partitionBy("case_id").orderBy("rank", "url"))
    return flagged.select("case_id", place.alias("place"), F.coalesce("hit", F.lit(False)).alias("hit"))


def retrieval_metrics(returned: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """case_id, precision, recall (at k), mrr and context_precision of each case with relevant URLs."""
    hits = distinct_hits(returned, relevant)
    upto = Window.partitionBy("case_id").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = hits.withColumn("so_far", F.sum(F.col("hit").cast("int")).over(upto))
    at_k = F.count_if(F.col("hit") & (F.col("place") <= k))
    found = running.groupBy("case_id").agg(
        at_k.alias("at_k"), F.min(F.when(F.col("hit"), F.col("place"))).alias("first"),
        F.sum(F.when(F.col("hit"), F.col("so_far") / F.col("place"))).alias("gain"), F.count_if(F.col("hit")).alias("hits"),
    )
    sizes = relevant.groupBy("case_id").agg(F.count_distinct("url").alias("wanted"))
    joined = sizes.join(found, "case_id", "left")
    zero = lambda x: F.round(F.coalesce(x, F.lit(0.0)), 6)
    return joined.select(
        "case_id", zero(F.col("at_k") / k).alias("precision"), zero(F.col("at_k") / F.col("wanted")).alias("recall"),
        zero(1 / F.col("first")).alias("mrr"), zero(F.try_divide("gain", "hits")).alias("context_precision"),
    )


def faithfulness(answers: DataFrame) -> DataFrame:
    """(case_id, faithfulness) of answers(case_id, text, context): the mean share of a sentence's content words in the context.

    Sentences without content words don't count; null where none counts.
    """
    known = content_words(F.col("context"))
    split = answers.select("case_id", known.alias("known"), F.explode_outer(claim_sentences(F.col("text"))).alias("s"))
    words = split.withColumn("words", content_words(F.col("s")))
    share = F.when(F.size("words") > 0, F.size(F.array_intersect("words", "known")) / F.size("words"))
    return words.groupBy("case_id").agg(F.round(F.avg(share), 6).alias("faithfulness"))


def answer_failures(cases: DataFrame) -> DataFrame:
    """(case_id, failures) of cases with expectations beside the answer's text, grounded, clarification and citations."""
    low = F.lower("text")
    checks = F.array(
        F.when(F.col("expect_grounded").isNotNull() & (F.col("grounded") != F.col("expect_grounded")), "grounded"),
        F.when(F.col("expect_clarification").isNotNull() & (F.col("clarification") != F.col("expect_clarification")), "clarification"),
        F.when(F.size("citations") < F.col("min_citations"), "citations"),
        F.when(F.exists("forbidden", lambda p: F.contains(low, F.lower(p))), "forbidden phrase"),
    )
    return cases.select("case_id", F.filter(checks, lambda c: c.isNotNull()).alias("failures"))


def gate(cases: DataFrame, precision: DataFrame) -> DataFrame:
    """One row: grounded rate, citation sufficiency rate, context precision and number of cases.

    cases(case_id, grounded, n_citations, min_citations); precision(case_id, context_precision).
    """
    joined = cases.join(precision, "case_id", "left")
    rate = lambda x: F.round(F.avg(F.when(x, 1.0).otherwise(0.0)), 6)
    return joined.agg(
        rate(F.col("grounded")).alias("grounded_rate"), rate(F.col("n_citations") >= F.col("min_citations")).alias("citation_sufficiency_rate"),
        F.round(F.avg("context_precision"), 6).alias("context_precision"), F.count("*").alias("case_count"),
    )
