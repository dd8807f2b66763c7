"""Ingestion of new snapshots: decisions, versions, indexing, remapping."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

METADATA = ["title", "department", "topic"]
THIN = 40


def decisions(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """incoming(url, content, content_hash, title, department, topic) with `status` against stored documents of the same columns.

    failed: thin; created: a new URL; updated: another hash or metadata; skipped: all the same.
    """
    old = stored.select("url", F.col("content_hash").alias("_hash"), *(F.col(c).alias(f"_{c}") for c in METADATA), F.lit(True).alias("_known"))
    joined = incoming.join(old, "url", "left")
    same = F.col("content_hash").eqNullSafe(F.col("_hash"))
    for c in METADATA:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    status = F.when(F.length("content") < THIN, "failed").when(F.col("_known").isNull(), "created").when(same, "skipped").otherwise("updated")
    changed = F.col("_known").isNotNull() & ~F.col("content_hash").eqNullSafe(F.col("_hash"))
    return joined.withColumn("status", status).withColumn("content_changed", changed).drop(*(f"_{c}" for c in METADATA), "_known").withColumnRenamed("_hash", "old_hash")


def version_rows(decided: DataFrame) -> DataFrame:
    """A version (url, old_hash, content_hash) for each document whose content changed."""
    return decided.filter(F.col("status") == "updated").filter("content_changed").select("url", "old_hash", "content_hash")


def after_ingest(decided: DataFrame, stored: DataFrame) -> DataFrame:
    """stored(url, content_hash, embedded_hash, index_status, last_crawled, ...) with decisions applied.

    Content, where it changed, loses its embedded hash; the index status is never reset; skipped
    documents only have their time of crawling renewed.
    """
    taken = decided.filter(F.col("status").isin("created", "updated", "skipped")).select("url", "status", "content_changed", "crawled", *(F.col(c).alias(f"n_{c}") for c in ["content_hash", *METADATA]))
    joined = stored.join(taken, "url", "full")
    renewed = F.col("status").isin("created", "updated")
    pick = lambda c: F.when(renewed, F.col(f"n_{c}")).otherwise(F.col(c)).alias(c)
    return joined.select(
        "url", pick("content_hash"), *map(pick, METADATA),
        F.when(~F.coalesce("content_changed", F.lit(False)), F.col("embedded_hash")).alias("embedded_hash"),
        F.coalesce("index_status", F.lit("approved")).alias("index_status"), F.coalesce("crawled", "last_crawled").alias("last_crawled"),
    )


def needs_index(docs: DataFrame) -> DataFrame:
    """docs that were never embedded, or not as they are."""
    return docs.filter(F.col("embedded_hash").isNull() | (F.col("embedded_hash") != F.col("content_hash")))


def index_pass(docs: DataFrame, chunk_counts: DataFrame, version: str) -> DataFrame:
    """url, status, embedded_hash and embedding_version after a pass over documents that need it; without chunks it fails."""
    pending = needs_index(docs).join(chunk_counts, "url", "left")
    has = F.coalesce("chunks", F.lit(0)) > 0
    return pending.select("url", F.when(has, "indexed").otherwise("failed").alias("status"), F.when(has, F.col("content_hash")).otherwise(F.col("embedded_hash")).alias("embedded_hash"), F.when(has, F.lit(version)).alias("embedding_version"))


def replaced_chunks(chunks: DataFrame, changed: DataFrame, fresh: DataFrame) -> DataFrame:
    """chunks without those of changed(document_id) documents, and the fresh ones."""
    return chunks.join(changed.select("document_id").distinct(), "document_id", "left_anti").select(*chunks.columns).unionByName(fresh)


def numbered(pieces: DataFrame) -> DataFrame:
    """pieces(document_id, place, section_index, ...) with chunk_number from 1 and local_index from 0 in the section."""
    by_doc = Window.partitionBy("document_id").orderBy("place")
    by_section = Window.partitionBy("document_id", "section_index").orderBy("place")
    return pieces.withColumn("chunk_number", F.row_number().over(by_doc).cast("long")).withColumn("local_index", (F.row_number().over(by_section) - 1).cast("long"))


def remapped(docs: DataFrame, renames: DataFrame, dropped: str, default: str, classified: DataFrame, threshold: float) -> DataFrame:
    """docs(url, topic, index_status) under a new taxonomy.

    Renamed topics (old, new) change; the dropped topic becomes the default and goes to review; documents
    under review take the classifier's topic (url, topic, confidence) and are approved if it is sure enough.
    """
    moved = docs.join(renames, F.col("topic") == F.col("old"), "left")
    topic = F.when(F.col("topic") == dropped, F.lit(default)).otherwise(F.coalesce("new", "topic"))
    status = F.when(F.col("topic") == dropped, F.lit("review")).otherwise(F.col("index_status"))
    staged = moved.select("url", topic.alias("topic"), status.alias("index_status")).join(classified.select("url", F.col("topic").alias("found"), "confidence"), "url", "left")
    sure = (F.col("index_status") == "review") & (F.coalesce("confidence", F.lit(0.0)) >= threshold)
    return staged.select("url", F.when(sure, F.col("found")).otherwise(F.col("topic")).alias("topic"), F.when(sure, "approved").otherwise(F.col("index_status")).alias("index_status"))
