"""Tables, and the logical tables that queries see.

The fixture has plain documents, so the attributes that retrieval filters on (topic, department, status,
student types and so on) are derived from its columns by fixed rules, in `corpus` and, for DuckDB, in
CORPUS_SQL. A document stands for one chunk; a vector of the same id is its embedding.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    strings = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    i = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        i.alias("chunk_id"),
        F.col("text").alias("content"),
        F.col("lang").alias("topic"),
        F.col("source").alias("department"),
        F.concat(F.lit("https://"), "source", F.lit(".example.org/d/"), i.cast("string")).alias("url"),
        F.concat(F.lit("Document "), i.cast("string")).alias("title"),
        F.when(i % 17 == 0, "review").otherwise("approved").alias("index_status"),
        F.when(i % 5 == 0, strings("freshman")).when(i % 5 == 1, strings("graduate", "transfer")).otherwise(strings()).alias("student_types"),
        F.when(i % 4 == 0, strings("current_student")).when(i % 4 == 1, strings("prospective_student", "alumni")).otherwise(strings()).alias("audience"),
        F.when(i % 3 == 1, "policy").when(i % 3 == 2, "faq").alias("document_type"),
        F.when(i % 11 != 0, 40 + i % 61).alias("retrieval_priority"),
    )


#: The same in DuckDB.
CORPUS_SQL = """corpus AS (SELECT doc_id AS chunk_id, text AS content, lang AS topic, source AS department,
  'https://' || source || '.example.org/d/' || doc_id AS url, 'Document ' || doc_id AS title,
  CASE WHEN doc_id % 17 = 0 THEN 'review' ELSE 'approved' END AS index_status,
  CASE doc_id % 5 WHEN 0 THEN ['freshman'] WHEN 1 THEN ['graduate', 'transfer'] ELSE []::VARCHAR[] END AS student_types,
  CASE doc_id % 4 WHEN 0 THEN ['current_student'] WHEN 1 THEN ['prospective_student', 'alumni'] ELSE []::VARCHAR[] END AS audience,
  CASE doc_id % 3 WHEN 1 THEN 'policy' WHEN 2 THEN 'faq' END AS document_type,
  CASE WHEN doc_id % 11 <> 0 THEN 40 + doc_id % 61 END AS retrieval_priority FROM documents)"""


def turn_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as conversation turns: one session a user; every third turn a greeting."""
    i = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        i.alias("turn_id"), F.col("user_id").alias("session_id"), F.col("ts").alias("created_at"),
        F.when(i % 3 == 0, "greeting").otherwise("question").alias("intent"),
        F.when(i % 7 != 0, F.col("event_type")).alias("topic"),
        (i % 10 == 0).alias("needs_clarification"),
        F.when(i % 4 != 0, i % 2 == 0).alias("grounded"),
        F.get_json_object("props", "$.k").cast("bigint").alias("citation_count"),
        F.when(i % 13 != 0, F.col("value")).alias("latency_ms"),
    )


TURN_EVENTS_SQL = """turn_events AS (SELECT event_id AS turn_id, user_id AS session_id, ts AS created_at,
  CASE WHEN event_id % 3 = 0 THEN 'greeting' ELSE 'question' END AS intent,
  CASE WHEN event_id % 7 <> 0 THEN event_type END AS topic, event_id % 10 = 0 AS needs_clarification,
  CASE WHEN event_id % 4 <> 0 THEN event_id % 2 = 0 END AS grounded,
  CAST(json_extract_string(props, '$.k') AS BIGINT) AS citation_count,
  CASE WHEN event_id % 13 <> 0 THEN value END AS latency_ms FROM events)"""


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as feedback with a rating, a time and two citations' rerank scores."""
    i = F.col("doc_id")
    score = lambda x: F.struct(x.cast("double").alias("rerank_score"))
    return table(spark, sf_dir, "labels").select(
        i.alias("feedback_id"), (i % 150).alias("session_id"),
        F.when(F.col("quality") == 1, "helpful").otherwise("not_helpful").alias("rating"),
        (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(hours=(i % 720).cast("int"))).alias("created_at"),
        F.when(i % 9 != 0, F.array(score(F.when(i % 4 != 0, (i % 50) / 10)), score(F.when(i % 6 != 0, (i % 37) / 10)))).alias("citations"),
    )


FEEDBACK_SQL = """feedback AS (SELECT doc_id AS feedback_id, doc_id % 150 AS session_id,
  CASE WHEN quality = 1 THEN 'helpful' ELSE 'not_helpful' END AS rating,
  TIMESTAMP '2024-01-01' + to_hours(CAST(doc_id % 720 AS INTEGER)) AS created_at,
  CASE WHEN doc_id % 9 <> 0 THEN [CASE WHEN doc_id % 4 <> 0 THEN (doc_id % 50) / 10 END,
    CASE WHEN doc_id % 6 <> 0 THEN (doc_id % 37) / 10 END] END AS scores FROM labels)"""
