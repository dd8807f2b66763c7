"""Queries of usage analytics, listings and manifests, feedback and tuning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.operators import analytics as A
from loam.plans.registry import query
from loam.sources.tables import CORPUS_SQL, FEEDBACK_SQL, TURN_EVENTS_SQL, corpus, feedback, table, turn_events

SINCE = "2024-01-10"
_SINCE_SQL = f"created_at >= TIMESTAMP '{SINCE}'"


def _since() -> Column:
    return F.lit(SINCE).cast("timestamp_ntz")


_RATES = """count(*) AS turn_count, round(avg(CASE WHEN intent = 'question' THEN CASE WHEN grounded THEN 1.0 ELSE 0.0 END END), 6) AS grounded_rate,
  round(avg(CASE WHEN needs_clarification THEN 1.0 ELSE 0.0 END), 6) AS clarification_rate, round(avg(latency_ms), 6) AS latency_avg,
  round(quantile_cont(latency_ms, 0.5), 6) AS latency_p50, round(quantile_cont(latency_ms, 0.95), 6) AS latency_p95"""


@query("a1_a3_a5_turn_rates", f"WITH {TURN_EVENTS_SQL} SELECT {_RATES} FROM turn_events WHERE {_SINCE_SQL}")
def turn_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1 count, A2 grounded rate, A3 clarification rate, A5 latency, F8 since; one pass."""
    return A.turn_rates(turn_events(spark, sf_dir).filter(F.col("created_at") >= _since()))


@query("a1_empty_rates", f"WITH {TURN_EVENTS_SQL} SELECT {_RATES} FROM turn_events WHERE created_at >= TIMESTAMP '2100-01-01'")
def empty_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of nothing are null."""
    return A.turn_rates(turn_events(spark, sf_dir).filter(F.col("created_at") >= F.lit("2100-01-01").cast("timestamp_ntz")))


@query("a4_topic_distribution", f"WITH {TURN_EVENTS_SQL} SELECT topic, count(*) AS n FROM turn_events WHERE topic IS NOT NULL GROUP BY topic")
def topic_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_events(spark, sf_dir).filter("topic IS NOT NULL").groupBy("topic").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "topic")


@query("a6_a7_feedback_ratio", f"WITH {FEEDBACK_SQL} SELECT count(*) FILTER (rating = 'helpful') AS helpful, count(*) FILTER (rating = 'not_helpful') AS not_helpful, round(count(*) FILTER (rating = 'helpful') / nullif(count(*), 0), 6) AS helpful_ratio FROM feedback")
def feedback_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.feedback_ratio(feedback(spark, sf_dir))


@query("a8_dashboard", f"""WITH {TURN_EVENTS_SQL}, {FEEDBACK_SQL} SELECT * FROM (SELECT {_RATES} FROM turn_events WHERE {_SINCE_SQL}),
  (SELECT count(*) FILTER (rating = 'helpful') AS helpful, count(*) FILTER (rating = 'not_helpful') AS not_helpful, round(count(*) FILTER (rating = 'helpful') / nullif(count(*), 0), 6) AS helpful_ratio
   FROM feedback WHERE {_SINCE_SQL}), (SELECT count(*) AS document_count FROM documents), (SELECT count(DISTINCT session_id) AS session_count FROM turn_events WHERE {_SINCE_SQL})""")
def dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All figures since a time, in one row; the corpus count ignores the time."""
    turns = turn_events(spark, sf_dir).filter(F.col("created_at") >= _since())
    rated = A.feedback_ratio(feedback(spark, sf_dir).filter(F.col("created_at") >= _since()))
    documents = table(spark, sf_dir, "documents").agg(F.count("*").alias("document_count"))
    sessions = turns.agg(F.count_distinct("session_id").alias("session_count"))
    return A.turn_rates(turns).crossJoin(rated).crossJoin(documents).crossJoin(sessions)


_MANIFEST_SQL = f"WITH {CORPUS_SQL}, parts AS (SELECT chunk_id, unnest(range(CAST(chunk_id % 4 AS BIGINT))) AS part FROM corpus)"


def _parts(docs: DataFrame) -> DataFrame:
    """A document's stand-in for chunks: doc_id modulo 4 of them, so some have none."""
    return docs.withColumn("part", F.explode(F.expr("CASE WHEN chunk_id % 4 > 0 THEN sequence(0, chunk_id % 4 - 1) ELSE array() END")))


@query("a9_manifest_counts", f"{_MANIFEST_SQL} SELECT department, topic, title, url, count(*) AS chunks FROM corpus JOIN parts USING (chunk_id) GROUP BY ALL")
def manifest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of each document; documents without any vanish."""
    return _parts(corpus(spark, sf_dir)).groupBy("department", "topic", "title", "url").agg(F.count("*").alias("chunks")).orderBy("topic", "department", "title", "url")


@query("a10_manifest_rollup", f"{_MANIFEST_SQL} SELECT topic, department, count(DISTINCT chunk_id) AS docs, count(*) AS chunks FROM corpus JOIN parts USING (chunk_id) GROUP BY ROLLUP (topic, department)")
def manifest_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(corpus(spark, sf_dir)).rollup("topic", "department").agg(F.count_distinct("chunk_id").alias("docs"), F.count("*").alias("chunks"))


@query("a11_a19_status_counts", f"WITH {CORPUS_SQL} SELECT index_status AS status, count(*) AS n FROM corpus GROUP BY 1")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).groupBy(F.col("index_status").alias("status")).agg(F.count("*").alias("n"))


_NEAREST = ", ".join(f"round(sorted[least(len(sorted), CAST(floor(len(sorted) * {p}) AS BIGINT) + 1)], 6) AS {name}" for p, name in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99")))


@query("a12_latency_nearest_rank", f"WITH {TURN_EVENTS_SQL} SELECT topic, round(mean, 6) AS mean, {_NEAREST}, round(sorted[-1], 6) AS max FROM (SELECT topic, avg(latency_ms) AS mean, list(latency_ms ORDER BY latency_ms) AS sorted FROM turn_events WHERE latency_ms IS NOT NULL GROUP BY topic)")
def latency_nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles by nearest rank: the value at place floor(n * p) from 0, at most the last."""
    return A.nearest_rank(turn_events(spark, sf_dir).filter("latency_ms IS NOT NULL"), "topic", "latency_ms")


@query("a16_a17_e11_tuning_candidate", f"""WITH {FEEDBACK_SQL}, scored AS (SELECT rating, list_min(scores) AS low FROM feedback), n AS (SELECT count(*) AS eligible,
  count(*) FILTER (rating = 'not_helpful' AND low < 1.0 + 1.0) / nullif(count(*), 0) AS rate FROM scored WHERE low IS NOT NULL)
SELECT eligible, round(rate, 6) AS flag_rate, CASE WHEN eligible < 20 THEN 'insufficient_samples' WHEN rate < 0.15 THEN 'no_signal' ELSE 'candidate' END AS decision,
  CASE WHEN eligible >= 20 AND rate >= 0.15 THEN least(1.0 + 0.25, 3.0) END AS candidate FROM n""")
def tuning_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.tuning_candidate(feedback(spark, sf_dir), 1.0)


@query("e10_regression_check", """WITH g AS (SELECT avg(quality) FILTER (doc_id % 2 = 0) AS g0, avg(quality) FILTER (doc_id % 2 = 1) AS g1, avg(toxic) FILTER (doc_id % 2 = 0) AS c0, avg(toxic) FILTER (doc_id % 2 = 1) AS c1,
  avg(quality * toxic) FILTER (doc_id % 2 = 0) AS p0, avg(quality * toxic) FILTER (doc_id % 2 = 1) AS p1 FROM labels) SELECT round(g1 - g0, 6) AS grounded_change, g1 < g0 OR c1 < c0 OR coalesce(p1 < p0 - 0.01, false) AS regressed FROM g""")
def regression_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E10 on rates before and after; even and odd documents stand for the two runs."""
    of = lambda x, half: F.avg(F.when(F.col("doc_id") % 2 == half, x))
    x = {"grounded_rate": F.col("quality"), "citation_sufficiency_rate": F.col("toxic"), "context_precision": F.col("quality") * F.col("toxic")}
    gates = table(spark, sf_dir, "labels").agg(*(of(c, half).alias(f"{name}_{when}") for name, c in x.items() for half, when in ((0, "before"), (1, "after"))))
    return gates.select(F.round(F.col("grounded_rate_after") - F.col("grounded_rate_before"), 6).alias("grounded_change"), A.regressed().alias("regressed"))


@query("st12_rate_limit_window", """WITH w AS (SELECT user_id, time_bucket(INTERVAL '1 minute', ts) AS window_start, row_number() OVER (PARTITION BY user_id, time_bucket(INTERVAL '1 minute', ts) ORDER BY ts, event_id) AS place FROM events)
SELECT user_id, window_start, count(*) FILTER (place <= 1) AS allowed, count(*) FILTER (place > 1) AS rejected FROM w GROUP BY ALL""")
def rate_limit_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST12 at one request a minute, so that the fixture's sparse events meet the limit."""
    return A.rate_limited(table(spark, sf_dir, "events"), 1)


@query("s8_point_lookup", f"WITH {CORPUS_SQL} SELECT chunk_id, title, url, topic FROM corpus WHERE chunk_id = 42")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).filter("chunk_id = 42").select("chunk_id", "title", "url", "topic")


@query("s9_paginated_listing", f"WITH {CORPUS_SQL} SELECT chunk_id, department, title, (SELECT count(*) FROM corpus) AS total FROM (SELECT * FROM corpus ORDER BY department, title, url LIMIT 20 OFFSET 40)")
def paginated_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus(spark, sf_dir)
    page = docs.orderBy("department", "title", "url").offset(40).limit(20).select("chunk_id", "department", "title")
    return page.crossJoin(docs.agg(F.count("*").alias("total")))


@query("s13_keyed_upsert", "SELECT coalesce(n.k, o.k) AS key, coalesce(n.v, o.v) AS value FROM (SELECT doc_id AS k, quality AS v FROM labels WHERE doc_id % 3 <> 0) o FULL JOIN (SELECT doc_id AS k, toxic + 10 AS v FROM labels WHERE doc_id % 2 = 0) n ON o.k = n.k")
def keyed_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    old = labels.filter("doc_id % 3 <> 0").select(F.col("doc_id").alias("key"), F.col("quality").alias("value"))
    new = labels.filter("doc_id % 2 = 0").select(F.col("doc_id").alias("key"), (F.col("toxic") + 10).alias("value"))
    return A.upserted(old, new, "key")


@query("w12_j16_feedback_since_last_change", f"WITH {FEEDBACK_SQL}, last AS (SELECT max(created_at) AS at_time FROM feedback WHERE feedback_id % 100 = 0) SELECT feedback_id, rating FROM feedback WHERE created_at > (SELECT at_time FROM last)")
def feedback_since_last_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W12 latest applied change (every hundredth row stands for one), J16 feedback newer than it."""
    rows = feedback(spark, sf_dir)
    last = rows.filter("feedback_id % 100 = 0").agg(F.max("created_at").alias("last"))
    return rows.join(F.broadcast(last), F.col("created_at") > F.col("last")).select("feedback_id", "rating")


@query("j12_orphan_feedback", f"WITH {TURN_EVENTS_SQL}, {FEEDBACK_SQL} SELECT feedback_id, session_id IN (SELECT session_id FROM turn_events WHERE session_id % 2 = 0) AS accepted FROM feedback")
def orphan_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    sessions = turn_events(spark, sf_dir).filter("session_id % 2 = 0").select("session_id", F.lit(True).alias("known")).distinct()
    return feedback(spark, sf_dir).join(sessions, "session_id", "left").select("feedback_id", F.coalesce("known", F.lit(False)).alias("accepted"))


@query("x2_union_outcomes", f"WITH {CORPUS_SQL} SELECT chunk_id, 'accepted' AS status FROM corpus WHERE index_status = 'approved' UNION ALL SELECT chunk_id, 'rejected' FROM corpus WHERE index_status <> 'approved'")
def union_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus(spark, sf_dir)
    part = lambda keep, status: docs.filter(keep).select("chunk_id", F.lit(status).alias("status"))
    return part("index_status = 'approved'", "accepted").unionByName(part("index_status <> 'approved'", "rejected"))


@query("j2_a18_document_texts", """WITH parts AS (SELECT doc_id, n, substr(text, CAST(n * 400 + 1 AS BIGINT), 400) AS part FROM (SELECT doc_id, text, unnest(range(greatest(1, (length(text) + 399) // 400))) AS n FROM documents))
SELECT doc_id, substr(string_agg(part, chr(10) || chr(10) ORDER BY n), 1, 2000) AS joined, count(*) AS parts FROM parts GROUP BY doc_id""")
def document_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J2 chunks of a document in order, A18 their texts joined by blank lines, cut to 2000 characters."""
    n = F.col("n")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.length("text") - 1) / 400).cast("int")))).alias("n"))
    parts = docs.select("doc_id", "n", F.substring("text", n * 400 + 1, F.lit(400)).alias("part"))
    return A.joined_parts(parts, "doc_id", 2000)


@query("s10_crawl_report", f"WITH {CORPUS_SQL} SELECT CASE WHEN length(content) < 500 THEN 'rejected' ELSE 'accepted' END AS status, url, title, department, topic, array_to_string(student_types, '|') AS student_types, CAST(length(content) AS BIGINT) AS char_count FROM corpus")
def crawl_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the CSV report of a crawl; sources.files.write_csv writes them."""
    status = F.when(F.length("content") < 500, "rejected").otherwise("accepted")
    return corpus(spark, sf_dir).select(status.alias("status"), "url", "title", "department", "topic", F.array_join("student_types", "|").alias("student_types"), F.length("content").cast("long").alias("char_count"))


@query("streaming_window_counts_batch", "SELECT time_bucket(INTERVAL '5 minutes', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch side of streaming.events.windowed."""
    from loam.streaming.events import windowed

    return windowed(table(spark, sf_dir, "events")).withColumn("total", F.round("total", 4))


@query("a14_distinct_sources", f"WITH {CORPUS_SQL} SELECT topic, count(DISTINCT url) AS urls, count(DISTINCT department) AS departments FROM corpus GROUP BY topic")
def distinct_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).groupBy("topic").agg(F.count_distinct("url").alias("urls"), F.count_distinct("department").alias("departments"))

