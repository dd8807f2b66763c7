"""Lexical and vector retrieval, fusion, relaxation and merging, for batches of queries."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.functions.text import priority_multiplier, tokens
from loam.operators.blocks import against, broadcast_if_small, kept, spread

# BM25 parameters, fusion constant, candidates a ranker, limits.
K1, B, EPSILON = 1.5, 0.75, 0.25
FUSION_K, CANDIDATES, LIMIT, MIN_SOURCES, MAX_MERGED = 60, 20, 5, 3, 20
#: Different terms of all queries up to which they go to every task.
MAX_ASKED = 200_000


def top(df: DataFrame, by: list[str], score: str, tie: str, k: int) -> DataFrame:
    """The k rows of each group with the highest score, ranked from 1; ties to the smaller `tie`."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), tie))
    return df.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= k)


def passes(topic: Column | None = None, student_type: Column | None = None, audience: Column | None = None, document_type: Column | None = None, null_type: bool = False) -> Column:
    """Retrieval filter: approved, and each attribute asked for; empty lists match everyone.

    null_type: whether rows without a document type match one that is asked for (the vector side's rule).
    """
    keep = F.col("index_status") == "approved"
    if topic is not None:
        keep = keep & (F.col("topic") == topic)
    if student_type is not None:
        keep = keep & ((F.size("student_types") == 0) | F.array_contains("student_types", student_type))
    if audience is not None:
        keep = keep & ((F.size("audience") == 0) | F.array_contains("audience", audience))
    if document_type is not None:
        same = F.col("document_type") == document_type
        keep = keep & (same | F.col("document_type").isNull() if null_type else same)
    return keep


def postings(corpus: DataFrame, asked: DataFrame) -> DataFrame:
    """(term, chunk_id, dl, df, tf) of corpus(chunk_id, content), from one pass over it, kept on the executors.

    Of terms that are asked for (term), a row for each chunk that has it, with df 1; of every other term one
    row with its number of chunks as df and no chunk; where the term is null, df is the number of all chunks
    and tf that of all their words. So only what a query needs leaves the tasks.
    """
    rows = spread(corpus.select("chunk_id", "content")).select("chunk_id", F.sort_array(tokens(F.col("content"))).alias("ts"))
    word = lambda i: F.element_at("ts", i)
    first = F.filter(F.sequence(F.lit(1), F.size("ts")), lambda i: (i == 1) | (word(i) != word(F.greatest(i - 1, F.lit(1)))))
    rows = rows.withColumn("edges", F.when(F.size("ts") > 0, first).otherwise(F.array().cast("array<int>")))  # where the sorted words change
    counted = F.transform("edges", lambda i, at: F.struct(word(i).alias("term"), (F.coalesce(F.get("edges", at + 1), F.size("ts") + 1) - i).cast("long").alias("tf"), F.size("ts").alias("dl")))
    all_words = F.array(F.struct(F.lit(None).cast("string").alias("term"), F.size("ts").cast("long").alias("tf"), F.size("ts").alias("dl")))
    listed = rows.select("chunk_id", F.explode(F.concat(all_words, counted)).alias("p"))
    few = broadcast_if_small(asked.select(F.col("term").alias("_asked")).distinct(), MAX_ASKED)
    marked = listed.select("chunk_id", "p.*").join(few, F.col("term") == F.col("_asked"), "left")
    place = lambda c: F.when(F.col("_asked").isNotNull(), F.col(c)).alias(c)
    return kept(marked.groupBy("term", place("chunk_id"), place("dl")).agg(F.count("*").alias("df"), F.sum("tf").alias("tf")))


def bm25(corpus: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, chunk_id, score) of all matches with a positive score, rounded to 6 decimals.

    corpus(chunk_id, content), queries(query_id, text). Frequent terms with a negative weight get a
    quarter of the mean weight of all terms.
    """
    asked = queries.select("query_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    index = postings(corpus, asked)
    totals = index.filter("term IS NULL").select(F.col("df").alias("n"), (F.col("tf") / F.col("df")).alias("avgdl"))
    frequency = index.filter("term IS NOT NULL").groupBy("term").agg(F.sum("df").alias("df"))
    raw = F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    weights = frequency.crossJoin(F.broadcast(totals)).select("term", "avgdl", raw.alias("idf"))
    mean = weights.agg(F.avg("idf").alias("mean_idf"))
    used = asked.join(weights, "term").crossJoin(F.broadcast(mean))
    used = used.withColumn("idf", F.when(F.col("idf") < 0, EPSILON * F.col("mean_idf")).otherwise(F.col("idf")))
    met = used.join(index.filter("chunk_id IS NOT NULL").select("term", "chunk_id", "dl", "tf"), "term")
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scored = met.groupBy("query_id", "chunk_id").agg(F.round(F.sum(part), 6).alias("score"))
    return scored.filter("score > 0")


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two float arrays, in double precision."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def vector_scores(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, chunk_id, score) of every row of vectors(chunk_id, embedding) against a stated query set."""
    asked = queries.select("query_id", F.col("embedding").alias("_query"))
    pairs = against(vectors.filter(F.col("embedding").isNotNull()).select("chunk_id", "embedding"), asked, "query_id")
    return pairs.select("query_id", "chunk_id", F.round(cosine(F.col("embedding"), F.col("_query")), 6).alias("score"))


def fuse(semantic: DataFrame, lexical: DataFrame, priorities: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Reciprocal rank fusion of two rankings (query_id, chunk_id, rank), times the priority multiplier.

    Chunks that `priorities` (chunk_id, retrieval_priority) doesn't know are dropped after the limit, so
    fewer rows than the limit may be left.
    """
    both = semantic.select("query_id", "chunk_id", F.col("rank").alias("semantic_rank")).join(
        lexical.select("query_id", "chunk_id", F.col("rank").alias("bm25_rank")), ["query_id", "chunk_id"], "full"
    )
    known = both.join(priorities.select("chunk_id", "retrieval_priority", F.lit(True).alias("known")), "chunk_id", "left")
    part = lambda rank: F.coalesce(F.lit(1.0) / (FUSION_K + F.col(rank)), F.lit(0.0))
    score = F.round((part("semantic_rank") + part("bm25_rank")) * priority_multiplier(F.col("retrieval_priority")), 9)
    ranked = top(known.withColumn("fused_score", score), ["query_id"], "fused_score", "chunk_id", limit)
    return ranked.filter("known").select("query_id", "chunk_id", "semantic_rank", "bm25_rank", "fused_score", "rank")


def relax(results: DataFrame, least: int = MIN_SOURCES) -> DataFrame:
    """Of results(query_id, variant, url, ...) of up to four filter variants, the rows of the chosen one.

    Variants: 0 all filters, 1 without topic, 2 without student type, 3 without both. Without the topic if
    that gives strictly more sources where there are under `least`; then without the student type likewise.
    """
    n = lambda v: F.count_distinct(F.when(F.col("variant") == v, F.col("url")))
    counts = results.groupBy("query_id").agg(*(n(v).alias(f"n{v}") for v in range(4)))
    drop_topic = (F.col("n0") < least) & (F.col("n1") > F.col("n0"))
    base, other = F.when(drop_topic, F.col("n1")).otherwise(F.col("n0")), F.when(drop_topic, F.col("n3")).otherwise(F.col("n2"))
    variant = drop_topic.cast("int") + F.when((base < least) & (other > base), 2).otherwise(0)
    return results.join(counts.select("query_id", variant.alias("variant")), ["query_id", "variant"])


def merge_fanout(results: DataFrame, limit: int = MAX_MERGED) -> DataFrame:
    """Of results(query_id, sub_query, chunk_id, fused_score) each chunk once, with its highest score."""
    best = results.groupBy("query_id", "chunk_id").agg(F.max("fused_score").alias("fused_score"))
    return top(best, ["query_id"], "fused_score", "chunk_id", limit)


def rerank(candidates: DataFrame, k: int) -> DataFrame:
    """candidates(query_id, chunk_id, query_terms, content) by a lexical score in place of a model's logits.

    The score is ten times the share of query terms that the content has, so the floor of 1 drops
    chunks with less than a tenth of them.
    """
    shared = F.size(F.array_intersect("query_terms", F.array_distinct(tokens(F.col("content")))))
    score = F.when(F.size("query_terms") > 0, F.round(10 * shared / F.size("query_terms"), 6)).otherwise(0.0)
    return top(candidates.withColumn("rerank_score", score), ["query_id"], "rerank_score", "chunk_id", k)


def _direction(i: Column, b: int) -> Column:
    """Component i of the fixed pseudo-random direction b."""
    return F.sin((i + 1) * (b + 1) * F.lit(math.e * 1000))


def _along(b: int) -> Column:
    return F.aggregate(F.transform("embedding", lambda x, i: x.cast("double") * _direction(i, b)), F.lit(0.0), lambda s, v: s + v)


def lsh_codes(vectors: DataFrame, bits: int = 8) -> DataFrame:
    """vectors with a `cell` of sign bits against fixed pseudo-random directions: a pruning index for vector search."""
    cell = sum(((_along(b) > 0).cast("int") * (1 << b) for b in range(bits)), F.lit(0))
    return vectors.withColumn("cell", cell)


def lsh_bounds(vectors: DataFrame, bits: int = 8) -> DataFrame:
    """Each row of lsh_codes with every other cell (`probe`) and the highest cosine (`bound`) that a vector there can have with it.

    Between a vector and all that lie beyond a hyperplane is at least its own angle to the hyperplane.
    """
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    length = lambda b: F.sqrt(F.aggregate(F.transform("embedding", lambda _, i: _direction(i, b) * _direction(i, b)), F.lit(0.0), lambda s, v: s + v))
    margins = vectors.withColumn("_margins", F.array(*(F.abs(_along(b)) / (norm * length(b)) for b in range(bits))))
    probes = margins.withColumn("probe", F.explode(F.array(*map(F.lit, range(1 << bits))))).filter("probe <> cell")
    beyond = F.greatest(F.lit(0.0), *(F.when(F.col("probe").bitwiseXOR(F.col("cell")).bitwiseAND(1 << b) != 0, F.get("_margins", F.lit(b))).otherwise(0.0) for b in range(bits)))
    return probes.withColumn("bound", F.sqrt(F.greatest(F.lit(0.0), 1 - beyond * beyond))).drop("_margins")
