"""Queries of context, answers, routing and citations over reranked benchmark items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.functions import text as T
from loam.operators import answers as N
from loam.operators.blocks import broadcast_if_small
from loam.operators.lexical import SMALL
from loam.plans.registry import query
from loam.plans.retrieval import RERANKED_SQL, reranked
from loam.plans.texts import ANSWER_TERMS_SQL, SENTENCES_SQL, _sql_any
from loam.sources.tables import CORPUS_SQL, corpus, table

#: Floor of the queries: the lexical scorer goes from 0 to 10, and items hold common words.
FLOOR = 6.0


def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reranked chunks with their metadata; pairs of documents stand for chunks of one section."""
    meta = corpus(spark, sf_dir).select("chunk_id", "title", "url", "department")
    half = F.floor(F.col("chunk_id") / 2)
    found = meta.join(broadcast_if_small(reranked(spark, sf_dir), SMALL), "chunk_id")
    return found.select(
        "query_id", "rank", "chunk_id", "content", "rerank_score", "title", "url", "department", half.alias("document_id"), F.lit(0).alias("section_index"),
        F.when(half % 2 == 0, F.concat(F.lit("Section "), half.cast("string"))).alias("parent_text"),
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text", T.answer_terms(F.col("text")).alias("query_terms"))


RANKED_SQL = f"""WITH {CORPUS_SQL}, {RERANKED_SQL}, ranked_meta AS (SELECT r.query_id, r.rank, r.chunk_id, r.content, r.rerank_score, title, url, department, r.chunk_id // 2 AS document_id,
  CASE WHEN r.chunk_id // 2 % 2 = 0 THEN 'Section ' || r.chunk_id // 2 END AS parent_text FROM reranked r JOIN corpus c ON c.chunk_id = r.chunk_id),
asked AS (SELECT item_id AS query_id, text, {ANSWER_TERMS_SQL.format('text')} AS query_terms FROM benchmark)"""
_SPLIT = "SELECT query_id, rank, sentence, place, list_intersect(query_terms, " + ANSWER_TERMS_SQL.format("sentence") + ") AS shared FROM (SELECT query_id, rank, query_terms, unnest(ss) AS sentence, generate_subscripts(ss, 1) AS place FROM (SELECT r.query_id, r.rank, query_terms, " + SENTENCES_SQL.format("content") + " AS ss FROM {0} r JOIN asked a ON a.query_id = r.query_id))"
ANSWER_SQL = f"""{RANKED_SQL}, used AS (SELECT * FROM ranked_meta WHERE rank <= 5 AND rerank_score >= {FLOOR}), split AS ({_SPLIT.format('used')}),
chosen AS (SELECT query_id, sentence, min(rank) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, rank ORDER BY len(shared) DESC, length(sentence) DESC, place) AS n FROM split) WHERE n = 1 AND len(shared) > 0 GROUP BY ALL),
picks AS (SELECT c.query_id, count(*) AS n, list(c.rank ORDER BY c.rank) AS ranks, string_agg('- ' || sentence || ' (' || department || ')', chr(10) ORDER BY c.rank) AS many,
  min('According to ' || title || ' (' || department || '):' || chr(10) || chr(10) || sentence) AS one FROM chosen c JOIN used u ON u.query_id = c.query_id AND u.rank = c.rank GROUP BY c.query_id),
answers AS (SELECT a.query_id, CASE WHEN n = 1 THEN one WHEN n > 1 THEN 'Based on official sources:' || chr(10) || chr(10) || many
  WHEN t.rerank_score >= {FLOOR} THEN 'According to ' || title || ' (' || department || '):' || chr(10) || chr(10) || content ELSE '{N.NO_RESULTS}' END AS text,
  n IS NOT NULL OR coalesce(t.rerank_score >= {FLOOR}, false) AS grounded,
  CASE WHEN n IS NOT NULL THEN ranks WHEN t.rerank_score >= {FLOOR} THEN [1] WHEN t.query_id IS NOT NULL THEN []::BIGINT[] END AS citations
  FROM asked a LEFT JOIN picks p ON p.query_id = a.query_id LEFT JOIN ranked_meta t ON t.query_id = a.query_id AND t.rank = 1)"""


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.extractive(questions(spark, sf_dir), ranked(spark, sf_dir), FLOOR)


@query("n1_w13_context_blocks", f"""{RANKED_SQL}, placed AS (SELECT *, row_number() OVER (PARTITION BY query_id, document_id ORDER BY rank) AS place FROM ranked_meta)
SELECT query_id, string_agg('[' || rank || '] ' || title || ' (' || department || '):' || chr(10) || CASE WHEN parent_text IS NOT NULL AND place = 1 THEN parent_text ELSE content END, chr(10) || chr(10) ORDER BY rank) AS context FROM placed GROUP BY query_id""")
def context_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.context(ranked(spark, sf_dir))


@query("n2_extractive_answer", f"{ANSWER_SQL} SELECT query_id AS item_id, text, grounded, array_to_string(citations, ',') AS citations FROM answers")
def extractive_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N2, N3, F11, W7, W8, X3."""
    return _answers(spark, sf_dir).select(F.col("query_id").alias("item_id"), "text", "grounded", F.array_join("citations", ",").alias("citations"))


_NEEDS_SQL = f"""cited AS (SELECT r.* FROM ranked_meta r JOIN (SELECT query_id, unnest(citations) AS rank FROM answers) c ON c.query_id = r.query_id AND c.rank = r.rank), csplit AS ({_SPLIT.format('cited')}),
best AS (SELECT query_id, max(len(shared)) AS best FROM csplit GROUP BY 1), cov AS (SELECT query_id, count(DISTINCT term) AS covered FROM (SELECT query_id, unnest(shared) AS term FROM csplit) GROUP BY 1),
needs AS (SELECT a.query_id, NOT grounded OR (contains(lower(q.text), 'both ') AND contains(lower(q.text), ' and ')) OR {_sql_any('lower(q.text)', T.COMPARISONS)} OR coalesce(covered > best, false) AS needs_synthesis
  FROM answers a JOIN asked q ON q.query_id = a.query_id LEFT JOIN best b ON b.query_id = a.query_id LEFT JOIN cov c ON c.query_id = a.query_id)"""


@query("n4_needs_synthesis", f"{ANSWER_SQL}, {_NEEDS_SQL} SELECT query_id, needs_synthesis FROM needs")
def needs_synthesis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N4, X5, T20."""
    return N.needs_synthesis(questions(spark, sf_dir), ranked(spark, sf_dir), _answers(spark, sf_dir))


@query("n5_n6_routed_answer", f"""{ANSWER_SQL}, {_NEEDS_SQL}, model AS (SELECT query_id, 'Model answer ' || query_id AS text, query_id % 2 = 0 AS grounded FROM asked)
SELECT a.query_id, CASE WHEN needs_synthesis AND m.grounded THEN m.text ELSE a.text END AS text, (needs_synthesis AND m.grounded) OR a.grounded AS grounded, needs_synthesis AND m.grounded AS from_model
FROM answers a JOIN needs USING (query_id) JOIN model m USING (query_id)""")
def routed_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N5 with a stand-in for the model (N6): it is grounded on even items."""
    asked, rows = questions(spark, sf_dir), ranked(spark, sf_dir)
    answers = N.extractive(asked, rows, FLOOR)
    model = asked.select("query_id", F.concat(F.lit("Model answer "), F.col("query_id").cast("string")).alias("text"), (F.col("query_id") % 2 == 0).alias("grounded"))
    return N.routed(answers, N.needs_synthesis(asked, rows, answers), model)


@query("n8_citations", f"""{ANSWER_SQL}, c AS (SELECT r.query_id, r.rank, url FROM answers a JOIN ranked_meta r ON r.query_id = a.query_id AND (a.citations IS NULL OR list_contains(a.citations, r.rank))),
f AS (SELECT query_id, url, min(rank) AS rank FROM c GROUP BY ALL) SELECT query_id, url, rank, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM f""")
def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N8, J14, F12, W8."""
    return N.citations(_answers(spark, sf_dir), ranked(spark, sf_dir))
