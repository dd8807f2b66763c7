"""Queries of ingestion. Two snapshots of the corpus: stored, and incoming with some documents new or changed."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.operators import ingest as I
from loam.operators import rechunk as R
from loam.operators import upsert as U
from loam.operators.blocks import spread
from loam.operators.store import shared_dir
from loam.plans.registry import query
from loam.sources.tables import CORPUS_SQL, corpus, table

_STORED_SQL = """stored AS (SELECT url, sha256(content) AS content_hash, title, department, topic, CASE WHEN chunk_id % 4 = 0 THEN NULL WHEN chunk_id % 4 = 1 THEN 'stale' ELSE sha256(content) END AS embedded_hash,
  index_status, CASE WHEN chunk_id % 2 = 0 THEN 1 END AS last_crawled FROM corpus WHERE chunk_id % 5 <> 0)"""
_INCOMING_SQL = """incoming AS (SELECT url, CASE WHEN chunk_id % 7 = 0 THEN content || ' changed' WHEN chunk_id % 13 = 0 THEN 'thin' ELSE content END AS content, CASE WHEN chunk_id % 11 = 0 THEN title || ' (new)' ELSE title END AS title,
  department, topic, 2 AS crawled FROM corpus WHERE chunk_id % 3 <> 0)"""
_DECIDED_SQL = f"""WITH {CORPUS_SQL}, {_STORED_SQL}, {_INCOMING_SQL}, decided AS (SELECT i.url, i.title, i.department, i.topic, i.crawled, sha256(i.content) AS content_hash, s.content_hash AS old_hash,
  s.url IS NOT NULL AND sha256(i.content) IS DISTINCT FROM s.content_hash AS content_changed,
  CASE WHEN length(i.content) < 40 THEN 'failed' WHEN s.url IS NULL THEN 'created' WHEN sha256(i.content) = s.content_hash AND i.title = s.title THEN 'skipped' ELSE 'updated' END AS status FROM incoming i LEFT JOIN stored s ON s.url = i.url)"""


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, digest = F.col("chunk_id"), F.sha2("content", 256)
    embedded = F.when(i % 4 == 1, "stale").when(i % 4 != 0, digest)
    return corpus(spark, sf_dir).filter("chunk_id % 5 <> 0").select("url", digest.alias("content_hash"), "title", "department", "topic", embedded.alias("embedded_hash"), "index_status", F.when(i % 2 == 0, 1).alias("last_crawled"))


def incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("chunk_id")
    content = F.when(i % 7 == 0, F.concat("content", F.lit(" changed"))).when(i % 13 == 0, "thin").otherwise(F.col("content"))
    title = F.when(i % 11 == 0, F.concat("title", F.lit(" (new)"))).otherwise(F.col("title"))
    rows = corpus(spark, sf_dir).filter("chunk_id % 3 <> 0").select("url", content.alias("content"), title.alias("title"), "department", "topic", F.lit(2).alias("crawled"))
    return rows.withColumn("content_hash", F.sha2("content", 256))


def decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.decisions(incoming(spark, sf_dir), stored(spark, sf_dir))


@query("st6_ingest_status", f"{_DECIDED_SQL} SELECT url, status FROM decided")
def ingest_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST6, F10, J8, C9."""
    return decided(spark, sf_dir).select("url", "status")


@query("st5_version_rows", f"{_DECIDED_SQL} SELECT url, old_hash, content_hash FROM decided WHERE status = 'updated' AND content_changed")
def version_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.version_rows(decided(spark, sf_dir))


_UPSERTED_SQL = f"""{_DECIDED_SQL}, taken AS (SELECT * FROM decided WHERE status <> 'failed')
SELECT coalesce(s.url, t.url) AS url, CASE WHEN t.status IN ('created', 'updated') THEN t.content_hash ELSE s.content_hash END AS content_hash, CASE WHEN t.status IN ('created', 'updated') THEN t.title ELSE s.title END AS title,
  CASE WHEN t.status IN ('created', 'updated') THEN t.department ELSE s.department END AS department, CASE WHEN t.status IN ('created', 'updated') THEN t.topic ELSE s.topic END AS topic,
  CASE WHEN NOT coalesce(t.content_changed, false) THEN embedded_hash END AS embedded_hash, coalesce(index_status, 'approved') AS index_status, coalesce(crawled, last_crawled) AS last_crawled FROM stored s FULL JOIN taken t ON t.url = s.url"""


@query("st5_st7_upserted_documents", _UPSERTED_SQL)
def upserted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST5, ST7."""
    return I.after_ingest(decided(spark, sf_dir), stored(spark, sf_dir))


@query("st7_partitioned_upsert", _UPSERTED_SQL)
def partitioned_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST5, ST7, S13: the same, into a stored table in partitions by department and bucket of the URL; those without incoming documents stay."""
    path = f"{shared_dir(spark)}/loam-documents/{uuid.uuid4().hex}"
    U.create(stored(spark, sf_dir), path, "url", "department", 4)
    taken = decided(spark, sf_dir).filter("status <> 'failed'").drop("content")
    U.upsert(spark, path, taken, "url", "department", 4, lambda old, changes: I.after_ingest(changes, old))
    return U.opened(spark, path)


@query("f9_needs_index", f"WITH {CORPUS_SQL}, {_STORED_SQL} SELECT url FROM stored WHERE embedded_hash IS NULL OR embedded_hash <> content_hash")
def needs_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.needs_index(stored(spark, sf_dir)).select("url")


@query("st8_index_pass", f"""WITH {CORPUS_SQL}, {_STORED_SQL}, counts AS (SELECT url, chunk_id % 3 AS chunks FROM corpus WHERE chunk_id % 3 > 0)
SELECT s.url, CASE WHEN chunks > 0 THEN 'indexed' ELSE 'failed' END AS status, CASE WHEN chunks > 0 THEN content_hash ELSE embedded_hash END AS embedded_hash, CASE WHEN chunks > 0 THEN 'v1' END AS embedding_version
FROM stored s LEFT JOIN counts c ON c.url = s.url WHERE embedded_hash IS NULL OR embedded_hash <> content_hash""")
def index_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = corpus(spark, sf_dir).select("url", (F.col("chunk_id") % 3).alias("chunks")).filter("chunks > 0")
    return I.index_pass(stored(spark, sf_dir), counts, "v1")


@query("c16_conditional_fetch", f"WITH {CORPUS_SQL} SELECT url FROM corpus WHERE TIMESTAMP '2024-01-01' + to_days(CAST(chunk_id % 30 AS INTEGER)) > TIMESTAMP '2024-01-15'")
def conditional_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages modified since the stored time."""
    modified = F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(days=(F.col("chunk_id") % 30).cast("int"))
    return corpus(spark, sf_dir).filter(modified > F.lit("2024-01-15").cast("timestamp_ntz")).select("url")


@query("k8_chunk_numbering", f"""WITH {CORPUS_SQL}, p AS (SELECT chunk_id // 4 AS document_id, chunk_id AS place, chunk_id % 4 // 2 AS section_index FROM corpus)
SELECT document_id, place, section_index, row_number() OVER (PARTITION BY document_id ORDER BY place) AS chunk_number, row_number() OVER (PARTITION BY document_id, section_index ORDER BY place) - 1 AS local_index FROM p""")
def chunk_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K8: four documents stand for the pieces of one, in two sections."""
    i = F.col("chunk_id")
    return I.numbered(corpus(spark, sf_dir).select(F.floor(i / 4).alias("document_id"), i.alias("place"), F.floor(i % 4 / 2).alias("section_index")))


@query("k9_replaced_chunks", f"WITH {CORPUS_SQL} SELECT chunk_id // 4 AS document_id, content FROM corpus WHERE chunk_id // 4 % 3 <> 0 UNION ALL SELECT chunk_id // 4, 'new ' || content FROM corpus WHERE chunk_id // 4 % 3 = 0")
def replaced_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = corpus(spark, sf_dir).select(F.floor(F.col("chunk_id") / 4).alias("document_id"), "content")
    changed = chunks.filter("document_id % 3 = 0")
    return I.replaced_chunks(chunks, changed, changed.withColumn("content", F.concat(F.lit("new "), "content")))


@query("st10_metadata_backfill", f"WITH {CORPUS_SQL} SELECT url, CAST(length(content) AS BIGINT) AS chars, CASE WHEN document_type IS NULL THEN 'program_description' ELSE document_type END AS document_type FROM corpus")
def metadata_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST10: what is missing is filled; what is known is carried through."""
    return corpus(spark, sf_dir).select("url", F.length("content").cast("long").alias("chars"), F.coalesce("document_type", F.lit("program_description")).alias("document_type"))


@query("st11_topic_remap", f"""WITH {CORPUS_SQL}, renames AS (SELECT * FROM (VALUES ('en', 'english'), ('fr', 'french')) r(old, new)), c AS (SELECT url, 'topic ' || chunk_id % 3 AS found, (chunk_id % 10) / 10 AS confidence FROM corpus),
s AS (SELECT url, CASE WHEN topic = 'de' THEN 'english' ELSE coalesce(new, topic) END AS topic, CASE WHEN topic = 'de' THEN 'review' ELSE index_status END AS index_status FROM corpus LEFT JOIN renames ON old = topic)
SELECT s.url, CASE WHEN index_status = 'review' AND confidence >= 0.55 THEN found ELSE topic END AS topic, CASE WHEN index_status = 'review' AND confidence >= 0.55 THEN 'approved' ELSE index_status END AS index_status FROM s JOIN c USING (url)""")
def topic_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus(spark, sf_dir)
    i = F.col("chunk_id")
    renames = spark.createDataFrame([("en", "english"), ("fr", "french")], "old string, new string")
    found = docs.select("url", F.concat(F.lit("topic "), (i % 3).cast("string")).alias("topic"), ((i % 10) / 10).alias("confidence"))
    return I.remapped(docs, renames, "de", "english", found, 0.55)




# A document's chunks are blocks of 50 words. By its number its new version is the same, has its first two blocks at the end, a new
# block after the second, no second block, or one word more at its start.
_WORDS = 50
_BLOCKS_SQL = f"SELECT document_id, i AS place, array_to_string(list_slice(w, i * {_WORDS} + 1, (i + 1) * {_WORDS}), ' ') AS content FROM (SELECT document_id, w, unnest(generate_series(0, (len(w) - 1) // {_WORDS})) AS i FROM {{0}} WHERE len(w) > 0)"
_RECHUNK_SQL = f"""WITH before AS (SELECT doc_id AS document_id, string_split(text, ' ') AS w FROM documents WHERE text IS NOT NULL),
after AS (SELECT document_id, CASE document_id % 5 WHEN 1 THEN list_concat(list_slice(w, 101, len(w)), list_slice(w, 1, 100)) WHEN 2 THEN list_concat(list_concat(list_slice(w, 1, 100), [ 'new' FOR x IN generate_series(1, 50) ]), list_slice(w, 101, len(w)))
  WHEN 3 THEN list_concat(list_slice(w, 1, 50), list_slice(w, 101, len(w))) WHEN 4 THEN list_concat(['new'], w) ELSE w END AS w FROM before),
old AS ({_BLOCKS_SQL.format('before')}), fresh AS ({_BLOCKS_SQL.format('after')}),
o AS (SELECT document_id, place AS old_place, content, row_number() OVER (PARTITION BY document_id, content ORDER BY place) AS nth FROM old),
n AS (SELECT document_id, place AS new_place, content, row_number() OVER (PARTITION BY document_id, content ORDER BY place) AS nth FROM fresh),
met AS (SELECT document_id, old_place, new_place, new_place - old_place AS shift FROM o FULL JOIN n USING (document_id, content, nth)),
islands AS (SELECT document_id, shift, new_place, new_place - row_number() OVER (PARTITION BY document_id, shift ORDER BY new_place) AS island FROM met WHERE shift <> 0),
runs AS (SELECT document_id, shift, min(new_place) AS low, max(new_place) AS high FROM islands GROUP BY document_id, shift, island),
longest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY high - low DESC, low) AS place FROM runs) WHERE place = 1)
SELECT m.document_id, old_place, new_place, CASE WHEN old_place IS NULL THEN 'added' WHEN new_place IS NULL THEN 'removed' WHEN m.shift = 0 THEN 'kept' WHEN m.shift = l.shift AND new_place BETWEEN low AND high THEN 'shifted' ELSE 'moved' END AS change
FROM met m LEFT JOIN longest l ON l.document_id = m.document_id"""


def _blocks(words: DataFrame) -> DataFrame:
    """(document_id, place, content): blocks of words(document_id, w)."""
    n = F.floor((F.size("w") - 1) / _WORDS)
    rows = words.filter(F.size("w") > 0).select("document_id", F.posexplode(F.transform(F.sequence(F.lit(0).cast("long"), n), lambda i: F.array_join(F.slice("w", (i * _WORDS + 1).cast("int"), _WORDS), " "))))
    return rows.select("document_id", F.col("pos").cast("long").alias("place"), F.col("col").alias("content"))


@query("st9_rechunk_changes", _RECHUNK_SQL)
def rechunk_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST9: what a new version of every document keeps, shifts, moves, adds and removes of its chunks."""
    before = spread(table(spark, sf_dir, "documents").filter("text IS NOT NULL")).select(F.col("doc_id").alias("document_id"), F.split("text", " ", -1).alias("w"))
    i, rest = F.col("document_id") % 5, lambda n: F.slice("w", n + 1, F.size("w") + 1)
    new = F.array_repeat(F.lit("new"), 50)
    edited = F.when(i == 1, F.concat(rest(100), F.slice("w", 1, 100))).when(i == 2, F.concat(F.slice("w", 1, 100), new, rest(100))).when(i == 3, F.concat(F.slice("w", 1, 50), rest(100)))
    after = before.select("document_id", edited.when(i == 4, F.concat(F.array(F.lit("new")), "w")).otherwise(F.col("w")).alias("w"))
    return R.changes(_blocks(before), _blocks(after))
