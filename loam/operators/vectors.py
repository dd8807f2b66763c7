"""A stored vector index: coarse cells, residual product codes, exact rescoring.

Building. Vectors are brought to length 1. K-means on a sample of at most `SAMPLE` gives centroids; what is left of a vector after
its nearest centroid is cut into `PARTS` slices, each replaced by the number of the nearest of 256 codewords,
fitted on the same sample. So a vector is `PARTS` bytes. Codes and vectors are stored by cell; a cell is cut into pieces of about `PIECE` vectors.

Search. A query probes cells from the nearest centroid on until they hold `PROBED` of all vectors. Blocks of queries meet pieces of
cells, every code there is scored by table lookups, and the `REFINED` best of each query are scored again on their whole vectors. Nothing
else of the vectors is read. Centroids and codewords are bounded, and all that goes to every task.

Defined results: vectors that are null, empty, zero, of another length than the commonest (of equally common ones the longest), or
hold null or non-finite entries are not in the index; queries like that find nothing. Ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.operators.blocks import broadcast_if_small, kept
from loam.operators.retrieval import cosine, top
from loam.operators.store import finish

SAMPLE, ROUNDS = 20_000, 12
PARTS, WORDS = 16, 256
#: Vectors of a cell about, and cells at most.
CELL, MAX_CELLS = 64, 4_096
PIECE, QUERIES = 8_192, 1_024
PROBED, REFINED = 0.8, 200
SEED = 11
CODES = "piece int, vec_id long, code binary, cell int"
VECTORS = "vec_id long, embedding array<float>, cell int"
SMALL = 200_000


class Index(NamedTuple):
    codes: DataFrame  # vec_id, code, piece, by cell
    vectors: DataFrame  # vec_id, embedding, by cell
    cells: DataFrame  # cell, n, pieces
    centroids: np.ndarray
    words: list[np.ndarray]  # the codewords of each slice


def sound(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    c = F.col(column)
    return vectors.filter(c.isNotNull() & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(c, lambda x: x != 0))


def k_means(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(ROUNDS):
        nearest = (x @ centres.T - 0.5 * (centres**2).sum(axis=1)).argmax(axis=1)
        sums, n = np.zeros_like(centres), np.bincount(nearest, minlength=len(centres))
        np.add.at(sums, nearest, x)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def _slices(d: int) -> list[slice]:
    edges = np.linspace(0, d, min(PARTS, d) + 1).astype(int)
    return [slice(a, b) for a, b in zip(edges, edges[1:], strict=False)]


def _unit(column: pa.Array, d: int) -> np.ndarray:
    x = np.asarray(column.flatten(), np.float64).reshape(-1, d)
    return x / np.linalg.norm(x, axis=1)[:, None]


def _coded(centroids: np.ndarray, words: list[np.ndarray], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    d = centroids.shape[1]
    for batch in batches:
        if not batch.num_rows:
            continue
        x = _unit(batch.column("embedding"), d)
        cell = (x @ centroids.T - 0.5 * (centroids**2).sum(axis=1)).argmax(axis=1)
        rest = x - centroids[cell]
        code = np.stack([(rest[:, s] @ w.T - 0.5 * (w**2).sum(axis=1)).argmax(axis=1) for s, w in zip(_slices(d), words, strict=True)], axis=1).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("embedding"), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(cell.astype(np.int32))], ["vec_id", "embedding", "code", "cell"])


def build(vectors: DataFrame, path: str) -> None:
    """Write the index of vectors(vec_id long, embedding array<float>) to a folder."""
    spark = vectors.sparkSession
    rows = sound(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding")).filter("vec_id IS NOT NULL"))
    usual = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d, n = (usual["d"], usual["count"]) if usual else (1, 0)
    rows = rows.filter(F.size("embedding") == d)
    drawn = rows.orderBy(F.xxhash64(F.lit(SEED), "vec_id"), "vec_id").limit(SAMPLE).select("embedding").collect()
    sample = np.array([r["embedding"] for r in drawn], np.float64).reshape(-1, d)
    sample /= np.linalg.norm(sample, axis=1)[:, None]
    rng = np.random.default_rng(SEED)
    centroids = k_means(sample, int(min(MAX_CELLS, max(1, n // CELL))), rng) if n else np.zeros((1, d))
    rest = sample - centroids[(sample @ centroids.T - 0.5 * (centroids**2).sum(axis=1)).argmax(axis=1)]
    words = [k_means(rest[:, s], WORDS, rng) if n else np.zeros((1, s.stop - s.start)) for s in _slices(d)]
    coded = rows.mapInArrow(partial(_coded, centroids, words), "vec_id long, embedding array<float>, code binary, cell int")
    coded = coded.repartitionByRange("cell", "vec_id").sortWithinPartitions("cell", "vec_id")
    coded.write.mode("overwrite").parquet(f"{path}/coded")
    coded = spark.read.parquet(f"{path}/coded")
    cells = coded.groupBy("cell").agg(F.count("*").alias("n"), F.ceil(F.count("*") / PIECE).cast("int").alias("pieces"))
    cells.write.mode("overwrite").parquet(f"{path}/cells")
    placed = coded.join(F.broadcast(spark.read.parquet(f"{path}/cells")), "cell").withColumn("piece", F.pmod(F.xxhash64("vec_id"), "pieces").cast("int"))
    placed.select("piece", "vec_id", "code", "cell").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/codes")
    coded.select("vec_id", "embedding", "cell").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/vectors")
    table = [(0, d, i, list(map(float, c))) for i, c in enumerate(centroids)] + [(1 + p, d, i, list(map(float, c))) for p, w in enumerate(words) for i, c in enumerate(w)]
    finish(spark.createDataFrame(table, "part int, d int, i int, centre array<double>").coalesce(1), path)  # bounded: cells and codewords


def opened(spark: SparkSession, path: str) -> Index:
    found: dict[int, list] = {}
    for r in sorted(spark.read.parquet(f"{path}/done").collect(), key=lambda r: (r["part"], r["i"])):
        found.setdefault(r["part"], []).append(r["centre"])
    read = lambda name, schema: spark.read.schema(schema).parquet(f"{path}/{name}")
    return Index(read("codes", CODES), read("vectors", VECTORS), spark.read.parquet(f"{path}/cells"), np.array(found[0]), [np.array(found[p]) for p in sorted(found) if p])


def _probe(centroids: np.ndarray, held: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Queries with the cells to look into, nearest first, until they hold PROBED of all vectors."""
    for batch in batches:
        if batch.num_rows:
            near = np.argsort(-(_unit(batch.column("embedding"), centroids.shape[1]) @ centroids.T - 0.5 * (centroids**2).sum(axis=1)), axis=1, kind="stable")
            enough = (np.cumsum(held[near], axis=1) - held[near]) < PROBED * held.sum()
            cells = [row[use].astype(np.int32) for row, use in zip(near, enough, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("embedding"), pa.array(cells, pa.list_(pa.int32()))], ["query_id", "embedding", "cells"])


def _by_codes(centroids: np.ndarray, words: list[np.ndarray], refined: int, codes: pa.Table, queries: pa.Table) -> pa.Table:
    """The best codes of one piece of a cell for one block of queries."""
    names = {"query_id": pa.int64(), "vec_id": pa.int64(), "near": pa.float64()}
    if not codes.num_rows or not queries.num_rows:
        return pa.table({n: pa.array([], t) for n, t in names.items()})
    d = centroids.shape[1]
    q = _unit(queries.column("embedding").combine_chunks(), d)
    code = np.frombuffer(b"".join(codes.column("code").to_pylist()), np.uint8).reshape(codes.num_rows, -1)
    scores = np.repeat((q @ centroids[codes.column("cell")[0].as_py()])[:, None], len(code), axis=1)
    for p, (s, w) in enumerate(zip(_slices(d), words, strict=True)):
        scores += (q[:, s] @ w.T)[:, code[:, p]]
    k = min(refined, len(code))
    best = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    ids = np.asarray(codes.column("vec_id"))[best]
    return pa.table({"query_id": np.repeat(np.asarray(queries.column("query_id")), k), "vec_id": ids.ravel(), "near": np.take_along_axis(scores, best, axis=1).ravel()})


def candidates(index: Index, queries: DataFrame, refined: int = REFINED) -> DataFrame:
    """(query_id, vec_id): the vectors that are scored exactly for queries(query_id, embedding)."""
    sizes = {r["cell"]: r["n"] for r in index.cells.collect()}  # MAX_CELLS at most
    held = np.array([sizes.get(c, 0) for c in range(len(index.centroids))], np.float64)
    right = sound(queries.select("query_id", "embedding")).filter(F.size("embedding") == index.centroids.shape[1])
    probes = right.mapInArrow(partial(_probe, index.centroids, held), "query_id long, embedding array<float>, cells array<int>")
    blocks = max(1, -(-queries.count() // QUERIES))
    asked = probes.select("query_id", "embedding", F.explode("cells").alias("cell"), F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"))
    asked = asked.join(F.broadcast(index.cells), "cell").select("query_id", "embedding", "cell", "block", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"))
    codes = index.codes.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    keys = ["cell", "piece", "block"]
    work = partial(_by_codes, index.centroids, index.words, refined)
    near = codes.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(lambda a, b: work(a, b), "query_id long, vec_id long, near double")
    return top(near, ["query_id"], "near", "vec_id", refined).select("query_id", "vec_id")


def search(index: Index, queries: DataFrame, k: int, refined: int = REFINED) -> DataFrame:
    """(query_id, vec_id, sim, rank): the k nearest found of each of queries(query_id, embedding), by cosine rounded to 6 decimals."""
    found = kept(candidates(index, queries, refined))
    asked = queries.select("query_id", F.col("embedding").alias("q"))
    pairs = index.vectors.select("vec_id", "embedding").join(broadcast_if_small(found, SMALL), "vec_id").join(broadcast_if_small(asked, SMALL // 4), "query_id")
    scored = pairs.select("query_id", "vec_id", F.round(cosine(F.col("embedding"), F.col("q")), 6).alias("sim"))
    return top(scored, ["query_id"], "sim", "vec_id", k)
