"""Exact nearest vectors by blocks against the expression of every pair, and against the SQL at sf0.1."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from loam.operators import nearest as module
from loam.operators import retrieval
from loam.queries import QUERIES, SQL
from tests.oracle import assert_same, connect

SF_DIR = "/root/testdata/sf0.1"


def rows_of(df):
    return sorted(repr([r[c] for c in ("query_id", "chunk_id", "score", "rank")]) for r in df.collect())


def plainly(vectors, queries, k):
    return retrieval.top(retrieval.vector_scores(vectors, queries), ["query_id"], "score", "chunk_id", k)


@pytest.mark.parametrize("k", [1, 5, 400])
def test_blocks_find_what_all_pairs_give(spark, monkeypatch, k):
    """Copies tie at the last rank, vectors are odd, blocks and cells are small: the same rows to the last digit."""
    monkeypatch.setattr(module, "QUERIES", 7)
    rng = random.Random(4)
    vectors = [(i, [rng.choice([-1.0, -0.5, 0.1, 0.3, 1.0]) for _ in range(4)]) for i in range(300)]
    vectors += [(1_000 + i, [0.1, 0.3, 1.0, -0.5]) for i in range(40)] + [(2_000, [1.0, float("nan"), 0.0, 1.0]), (2_001, [1.0, 2.0]), (2_002, [1.0, None, 2.0, 0.5])]
    vectors = spark.createDataFrame(vectors, "chunk_id long, embedding array<float>")
    queries = vectors.filter("chunk_id % 10 = 0").withColumnRenamed("chunk_id", "query_id").unionByName(spark.createDataFrame([(5_000, None)], "query_id long, embedding array<float>"))
    same = vectors.filter(F.size("embedding") == 4)
    asked = queries.filter(F.col("embedding").isNull() | (F.size("embedding") == 4))
    assert rows_of(module.nearest(same, asked, k)) == rows_of(plainly(same, asked, k))
    sound = vectors.filter("chunk_id < 2000")
    cells = retrieval.lsh_codes(sound, 3)
    found = module.nearest_in_cells(cells, cells.filter("chunk_id % 10 = 0").withColumnRenamed("chunk_id", "query_id"), k, lambda q: retrieval.lsh_bounds(q, 3))
    assert rows_of(found) == rows_of(plainly(sound, queries.filter("query_id < 2000"), k))
    assert module.nearest(sound.limit(0), queries, k).count() == 0 and module.nearest(sound, queries.limit(0), k).count() == 0


@pytest.mark.parametrize("name", ["r2_vector_topk", "r3_vector_topk_pruned", "r10_w6_topic_classify", "r11_crawl_topic", "e14_topic_accuracy"])
def test_no_pair_is_a_row(spark, name):
    """Equal to the SQL at sf0.1, and no join makes a row of every pair."""
    df = QUERIES[name](spark, SF_DIR)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "list_cosine" not in plan and "zip_with" not in plan
    assert_same(df, connect(SF_DIR), SQL[name])
