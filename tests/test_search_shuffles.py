"""What building and searching the word index shuffles: texts once, the blocks asked for once, no row a pair of query and chunk."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from loam.operators import lexical, retrieval
from loam.queries import QUERIES
from loam.sources.tables import corpus

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    lexical.build(corpus(spark, SF_DIR), path)
    return lexical.opened(spark, path)


def questions(spark, scope):
    items = spark.read.parquet(f"{SF_DIR}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text")
    return items.withColumn("scope", F.lit(scope)).withColumn("statistics", F.lit(scope))


def test_scores_are_made_in_the_task_of_their_shard(spark, index):
    """Before, every match of a word was a row that was shuffled by query and chunk."""
    plan = lexical.search(index, questions(spark, lexical.EVERYTHING), 20)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [query_id" not in plan and "explode(postings" not in plan and "MapInArrow" in plan


def test_an_index_holds_each_posting_once(spark, index):
    """a block a word and shard, made without a shuffle of postings; frequencies are those of the texts."""
    blocks = index.blocks.select("term", "shard", "max_tf", "min_dl", F.explode("postings").alias("p")).select("term", "shard", "max_tf", "min_dl", "p.*")
    assert index.blocks.groupBy("term", "shard").count().filter("count > 1").count() == 0
    got = blocks.filter(F.col("term") != lexical.ALL).groupBy("chunk_id", "term").agg(F.sum("tf").alias("tf"), F.max("dl").alias("dl"))
    ts = spark.read.parquet(f"{SF_DIR}/documents.parquet").select(F.col("doc_id").alias("chunk_id"), F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0)).alias("ts"))
    wanted = ts.select("chunk_id", F.size("ts").alias("dl"), F.explode("ts").alias("term")).groupBy("chunk_id", "term").agg(F.count("*").alias("tf"), F.max("dl").alias("dl"))
    assert got.exceptAll(wanted).isEmpty() and wanted.exceptAll(got).isEmpty()
    assert blocks.groupBy("term", "shard").agg((F.max("tf") == F.first("max_tf")).alias("a"), (F.min("dl") == F.first("min_dl")).alias("b")).filter("NOT a OR NOT b").isEmpty()


def test_parts_of_queries_find_the_same(spark, index, monkeypatch):
    scope = lexical.EVERYTHING
    rows = lambda df: {tuple(r[c] for c in ("query_id", "chunk_id", "score", "rank")) for r in df.collect()}
    whole = rows(lexical.search(index, questions(spark, scope), 7))
    monkeypatch.setattr(lexical, "MATRIX", 8_000)
    assert whole and rows(lexical.search(index, questions(spark, scope), 7)) == whole
    docs = corpus(spark, SF_DIR).filter("index_status = 'approved' AND topic = 'en'").select("chunk_id", "content")
    plain = retrieval.top(retrieval.bm25(docs, questions(spark, scope).select("query_id", "text")), ["query_id"], "score", "chunk_id", 7)
    assert rows(lexical.search(index, questions(spark, "approved\x1f=en\x1f*"), 7)) == rows(plain)


@pytest.mark.parametrize("name", ["r9_w5_rerank", "n1_w13_context_blocks"])
def test_texts_stay_where_they_are(spark, name):
    """Candidates go to the texts; before, all texts were sorted and shuffled to meet them where Spark could not tell their number."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin [chunk_id" not in plan
