"""Stored and built indexes against plain versions: inverted index, substring index."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loam.operators import embed, lexical, retrieval, substrings, vectors
from loam.operators.store import built, fingerprint
from loam.sources.tables import corpus

SF_DIR = "/root/testdata/sf0.01"
CORPUS = "chunk_id long, content string, topic string, student_types array<string>, index_status string, audience array<string>, document_type string"


@pytest.fixture(scope="module")
def fixture_index(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    lexical.build(corpus(spark, SF_DIR), path)
    return lexical.opened(spark, path)


def small(spark, rows):
    full = [(i, t, topic, types, status, [], None) for i, t, topic, types, status in rows]
    return spark.createDataFrame(full, CORPUS)


def asked(spark, rows):
    return spark.createDataFrame(rows, "query_id long, text string, scope string").withColumn("statistics", F.col("scope"))


def test_index_equals_the_scorer_and_skips_shards(spark, fixture_index):
    items = spark.read.parquet(f"{SF_DIR}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text")
    queries = items.withColumn("scope", F.lit(lexical.EVERYTHING)).withColumn("statistics", F.lit(lexical.EVERYTHING))
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))
    wanted = retrieval.top(retrieval.bm25(docs, items), ["query_id"], "score", "chunk_id", 20)
    columns = ["query_id", "chunk_id", "score", "rank"]
    assert {tuple(r) for r in lexical.search(fixture_index, queries, 20).select(columns).collect()} == {tuple(r) for r in wanted.select(columns).collect()}
    begun = lexical.begun(fixture_index, queries, 20)
    assert begun.chosen.count() <= 0.75 * begun.bounds.count()


def test_a_search_reads_no_text_and_only_its_buckets(spark, fixture_index):
    plan = lexical.search(fixture_index, asked(spark, [(0, "the housing", lexical.EVERYTHING)]), 5)._jdf.queryExecution().toString()
    assert "PartitionFilters: [bucket" in plan.replace("#", " ").replace("PartitionFilters: [isnotnull", "PartitionFilters: [bucket") and "content" not in plan


def test_statistics_of_every_filter_follow_their_definition(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices("a b c d e f g".split(), k=rng.randint(0, 9))), rng.choice(["x", "y", None]), rng.choice([[], ["s"], ["s", "t"]]), rng.choice(["approved", "review"])) for i in range(60)]
    lexical.build(small(spark, [*rows, (99, None, "x", [], "approved")]), str(tmp_path))
    found = {r["scope"]: r for r in lexical.opened(spark, str(tmp_path)).scopes.collect()}
    for topic in ("x", "y", None):
        for kind in ("s", "t", None):
            texts = [r[1].split() for r in rows if r[4] == "approved" and (topic is None or r[2] == topic) and (kind is None or not r[3] or kind in r[3])]
            texts += [[]] if topic in ("x", None) else []
            name = "\x1f".join(["approved", *("*" if c is None else f"={c}" for c in (topic, kind))])
            df = Counter(w for t in texts for w in set(t))
            weights = [math.log(len(texts) - k + 0.5) - math.log(k + 0.5) for k in df.values()]
            assert (found[name]["n"], found[name]["words"], found[name]["terms"]) == (len(texts), sum(map(len, texts)), len(df))
            assert found[name]["mean_idf"] == pytest.approx(sum(weights) / len(weights))


def test_searches_of_odd_inputs(spark, tmp_path):
    rows = [(0, "", "x", [], "approved"), (1, None, None, [], "approved"), (2, "word " * 20_000, "x", [], "approved"), *((i, "rare word", "x", ["s"], "approved") for i in range(3, 40)), (40, "rare unapproved", "x", [], "review")]
    rows += [(i, f"filler {i}", "z", [], "approved") for i in range(50, 150)]
    lexical.build(small(spark, rows), str(tmp_path / "a"))
    index = lexical.opened(spark, str(tmp_path / "a"))
    queries = asked(spark, [(0, "rare", "approved\x1f=x\x1f=s"), (1, "unknown", "approved\x1f*\x1f*"), (2, "", "approved\x1f*\x1f*"), (3, None, "approved\x1f*\x1f*"), (4, "rare", "approved\x1f=nowhere\x1f*"), (5, "rare rare word", "approved\x1f*\x1f*"), (6, "unapproved", "approved\x1f*\x1f*")])
    found = lexical.search(index, queries, 3).orderBy("query_id", "rank").select("query_id", "chunk_id").collect()
    assert [tuple(r) for r in found if r[0] == 5] == [(5, 3), (5, 4), (5, 5)] and {r[0] for r in found} <= {0, 5}
    lexical.build(small(spark, []), str(tmp_path / "b"))
    assert lexical.search(lexical.opened(spark, str(tmp_path / "b")), queries, 3).count() == 0


def test_an_index_is_built_once_for_a_state_of_its_table(spark, tmp_path):
    path, made = str(tmp_path / "t.parquet"), []
    spark.range(3).write.parquet(path)

    def build(folder):
        made.append(folder)
        spark.range(1).write.parquet(f"{folder}/done")

    key = fingerprint(spark, path)
    assert built(spark, "test", key, build) == built(spark, "test", fingerprint(spark, path), build) and len(made) == 1
    spark.range(4).write.mode("append").parquet(path)
    assert fingerprint(spark, path) != key


def test_contained_strings_against_brute_force(spark):
    rng = random.Random(2)
    vocabulary = ["alpha", "beta", "gamma", "delta", "é", "日本語", "\n", "x" * 15]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 60))) for _ in range(150)] + ["", None, "alpha " * 30_000]
    strings = [t[a : a + rng.randint(1, 60)] for t in texts[:150] if t for a in [rng.randrange(len(t))]] + ["", None, "alpha", "no such text anywhere in here", "alpha " * 20, " ", "日本語日本語日本語日本語日本語"]
    as_rows = lambda column, values: spark.createDataFrame(list(enumerate(values)), f"{column} long, text string")
    df = substrings.containing(as_rows("text_id", texts), as_rows("string_id", strings))
    found = [tuple(r) for r in df.collect()]
    assert len(found) == len(set(found)) and set(found) == {(i, j) for i, s in enumerate(strings) for j, t in enumerate(texts) if s is not None and t is not None and s in t}
    longer = substrings.containing(as_rows("text_id", texts), as_rows("string_id", [s for s in strings if s and " " in s[:20] and len(s) > 40]))
    assert "NestedLoop" not in longer._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("table", ["/root/testdata/sf0.1", "/root/testdata/check_s"])
def test_vector_index_recall_and_share_compared(spark, tmp_path, table):
    """At 2,000 and 10,256 vectors: recall at 20 of 0.9 at least, a fifth of the vectors at most scored exactly."""
    df = spark.read.parquet(f"{table}/embeddings.parquet").select("vec_id", "embedding")
    vectors.build(df, str(tmp_path))
    index = vectors.opened(spark, str(tmp_path))
    queries = df.filter("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    rows = df.collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows])
    found = {}
    for r in vectors.search(index, queries, 20).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["sim"]))
    hits = 0
    for q, got in found.items():
        sims = x @ x[ids == q][0]
        hits += len(set(ids[np.argsort(-sims)[:20]]) & {v for _, v, _ in got})
        assert [r for r, _, _ in sorted(got)] == list(range(1, 21)) and all(abs(s - sims[ids == v][0]) < 1e-5 for _, v, s in got)
    assert len(found) == queries.count() and hits >= 0.9 * 20 * len(found)
    assert vectors.candidates(index, queries).count() <= 0.2 * len(found) * len(rows)


def test_vector_index_of_odd_inputs(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.9, 0.1]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [1.0, None]), (9, [1.0]), (10, []), (None, [1.0, 1.0]), (11, [2.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    vectors.build(df, str(tmp_path / "a"))
    queries = spark.createDataFrame([(0, [3.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [1.0])], "query_id long, embedding array<float>")
    found = vectors.search(vectors.opened(spark, str(tmp_path / "a")), queries, 2).orderBy("rank").collect()
    assert [(r["query_id"], r["vec_id"], r["sim"]) for r in found] == [(0, 1, 1.0), (0, 11, 1.0)]
    vectors.build(df.limit(0), str(tmp_path / "b"))
    assert vectors.search(vectors.opened(spark, str(tmp_path / "b")), queries, 2).count() == 0


def test_embedder_against_a_plain_decomposition(spark, tmp_path):
    """The rows of 400 documents keep as much along our axes as along numpy's own; vectors are rows along the axes."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").filter("doc_id < 400").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))
    embed.build(docs, str(tmp_path))
    embedder, found = embed.opened(spark, str(tmp_path))
    rows = spark.read.parquet(f"{tmp_path}/counts").collect()
    a, n = np.zeros((len(rows), embed.WIDTH)), len(rows)
    for i, r in enumerate(rows):
        np.add.at(a[i], r["buckets"], r["counts"])
    weights = np.log(1 + n / np.maximum((a > 0).sum(axis=0), 1)) * (a > 0).any(axis=0)
    assert np.allclose(weights, embedder.weights)
    a = np.where(a > 0, 1 + np.log(np.maximum(a, 1)), 0) * weights
    a /= np.maximum(np.linalg.norm(a, axis=1), 1e-300)[:, None]
    best = np.linalg.svd(a, compute_uv=False)
    assert np.allclose(embedder.axes.T @ embedder.axes, np.eye(embed.DIMENSIONS), atol=1e-8)
    lost = lambda kept: (a**2).sum() - kept
    assert lost(((a @ embedder.axes) ** 2).sum()) <= 1.02 * lost((best[: embed.DIMENSIONS] ** 2).sum())
    assert np.allclose(embedder.values[:10], best[:10], rtol=1e-2)
    got = {r["chunk_id"]: r["embedding"] for r in found.collect()}
    along = a @ embedder.axes
    for r, v in zip(rows, along, strict=True):
        assert got[r["chunk_id"]] is None if not v.any() else np.allclose(got[r["chunk_id"]], v / np.linalg.norm(v), atol=1e-5)


def test_texts_find_their_documents(spark):
    """Asked with the later two thirds of its text, a document is among its ten nearest nine times in ten."""
    from loam.plans.retrieval import text_vectors

    embedder, index = text_vectors(spark, SF_DIR)
    docs = [r for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").filter("doc_id % 10 = 0").collect() if r["text"] and len(r["text"].split()) >= 100]
    asked = spark.createDataFrame([(r["doc_id"], r["text"][len(r["text"]) // 3 :]) for r in docs], "query_id long, content string")
    found = {}
    for r in vectors.search(index, embed.embedded(asked, embedder, "query_id"), 10).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert len(docs) > 30 and sum(r["doc_id"] in found[r["doc_id"]] for r in docs) >= 0.9 * len(docs)


def test_embedder_of_odd_inputs(spark, tmp_path):
    docs = spark.createDataFrame([(0, None), (1, ""), (2, "!?"), (3, "one two"), (4, "one two"), (5, "three " * 50_000)], "chunk_id long, content string")
    embed.build(docs, str(tmp_path / "a"))
    embedder, found = embed.opened(spark, str(tmp_path / "a"))
    got = {r["chunk_id"]: r["embedding"] for r in found.collect()}
    assert [got[i] for i in range(3)] == [None] * 3 and got[3] == got[4] and got[5] is not None
    asked = embed.embedded(spark.createDataFrame([(0, "two"), (1, "unheard"), (2, None)], "query_id long, content string"), embedder, "query_id").collect()
    assert [r["embedding"] is None for r in sorted(asked)] == [False, True, True]
    embed.build(docs.limit(0), str(tmp_path / "b"))
    assert embed.opened(spark, str(tmp_path / "b"))[1].count() == 0
