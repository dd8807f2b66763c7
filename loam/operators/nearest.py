"""Exact nearest vectors by cosine: all pairs as matrix products of blocks, of which only each query's best leave a task.

Queries are dealt to blocks of about `QUERIES`, vectors to stripes; a task meets the queries of a block first and then streams the
vectors of a stripe past them, a batch at a time, so what it holds is bounded by a block and a batch. The matrix product only
chooses: a pair that may be among the k best is computed again, in the order of `retrieval.cosine`, and rounded as Spark rounds, so
results equal those of the expression to the last digit. The work is the product of both sizes, as the exact job has it; what is
shuffled is the vectors once for each block of queries, and k rows a query and stripe.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.operators.blocks import against, kept
from loam.operators.retrieval import cosine, top

QUERIES, CHUNK = 2_048, 2_048
#: What matrix products and sums in order may differ by, with room to spare.
SLACK = 1e-9
FOUND = "query_id long, chunk_id long, score double"


def rounded(x: np.ndarray) -> np.ndarray:
    """x rounded to 6 decimals, halves away from zero, as Spark's round does with the shortest digits of a double."""
    scaled = np.abs(x) * 1e6
    out = np.sign(x) * np.floor(scaled + 0.5) / 1e6 + 0.0
    for i in np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-6):  # near a half the digits decide
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal("0.000001"), ROUND_HALF_UP)) + 0.0
    return out


def k_best(query: np.ndarray, found: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each query (a number) the k rows with the highest score, ties to the smaller found, in that order; and which of them are a query's k-th."""
    order = np.lexsort((found, -score, query))
    query, found, score = query[order], found[order], score[order]
    place = np.arange(len(query)) - np.searchsorted(query, query)
    keep = place < k
    return query[keep], found[keep], score[keep], np.flatnonzero(place[keep] == k - 1)


def _in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of a and b, added up from the first component on."""
    total = np.zeros(len(a))
    for i in range(a.shape[1]):
        total += a[:, i] * b[:, i]
    return total


class _Block:
    """The queries of a block with the k best vectors seen so far; ties go to the smaller id."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, floor: np.ndarray, k: int) -> None:
        self.ids, self.x, self.k = ids, x, k
        self.norm = np.sqrt(_in_order(x, x))
        self.unit = x / self.norm[:, None]
        self.floor = floor  # what a vector's rounded score must reach
        self.query, self.found, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def meet(self, ids: np.ndarray, x: np.ndarray) -> None:
        norm = np.sqrt(_in_order(x, x))
        near = self.unit @ (x / norm[:, None]).T
        floor = self.floor
        if len(ids) >= self.k:
            floor = np.maximum(floor, np.where(np.isinf(floor), np.partition(near, -self.k, axis=1)[:, -self.k], floor))
        q, v = np.nonzero(near >= (floor - 2e-6)[:, None])
        q, v = q.astype(np.int64), v.astype(np.int64)
        for at in range(0, len(q), 1 << 18):
            i, j = q[at : at + (1 << 18)], v[at : at + (1 << 18)]
            score = rounded(_in_order(x[j], self.x[i]) / (norm[j] * self.norm[i]))
            self._merge(i, ids[j], score)

    def _merge(self, query: np.ndarray, found: np.ndarray, score: np.ndarray) -> None:
        together = (np.concatenate([self.query, query]), np.concatenate([self.found, found]), np.concatenate([self.score, score]))
        self.query, self.found, self.score, last = k_best(*together, self.k)
        self.floor[self.query[last]] = np.maximum(self.floor[self.query[last]], self.score[last])

    def rows(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.ids[self.query]), pa.array(self.found), pa.array(self.score)], ["query_id", "chunk_id", "score"])


def _best(d: int, k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by place; the queries of a place come first, then its vectors."""
    current, block, waiting = None, None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        place, side = np.asarray(batch.column("place")), np.asarray(batch.column("side"))
        ids, floor = np.asarray(batch.column("id")), np.asarray(batch.column("floor"))
        x = np.asarray(batch.column("embedding").flatten(), np.float64).reshape(-1, d)
        edges = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (side[1:] != side[:-1]), True])
        for a, b in zip(edges, edges[1:], strict=False):
            if place[a] != current:
                if block is not None:
                    yield block.rows()
                current, block, waiting = place[a], None, []
            if side[a] == 0:
                waiting.append((ids[a:b], x[a:b], floor[a:b]))
            elif waiting or block is not None:
                if block is None:
                    block = _Block(*(np.concatenate(c).copy() for c in zip(*waiting, strict=True)), k)
                    waiting = []
                for at in range(a, b, CHUNK):
                    block.meet(ids[at : min(b, at + CHUNK)], x[at : min(b, at + CHUNK)])
    if block is not None:
        yield block.rows()


def _plain(df: DataFrame, key: str, d: int) -> DataFrame:
    """df with `plain`: whether it has an id and a vector of d finite components, not all zero."""
    c = F.col("embedding")
    sound = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(c, lambda x: x != 0)
    return df.withColumn("plain", F.coalesce(F.col(key).isNotNull() & (F.size(c) == d) & sound, F.lit(False)))


def grouped(vectors: DataFrame, queries: DataFrame, d: int, k: int) -> DataFrame:
    """(query_id, chunk_id, score): at least the k best vectors(cell, chunk_id, embedding) of each of queries(cell, query_id, embedding, floor) in
    its cells; what is under a query's floor may be missing. Vectors have d components, as `_plain` says; a query may have rows in several cells.
    """
    largest = queries.groupBy("cell").count().agg(F.max("count"), F.count("*")).first()
    if not largest[1]:
        return queries.sparkSession.createDataFrame([], FOUND)
    blocks, tasks = -(-largest[0] // QUERIES), 2 * queries.sparkSession.sparkContext.defaultParallelism
    stripes = max(1, -(-tasks // (blocks * largest[1])))
    place = (F.col("cell").cast("long") * blocks + F.col("block")) * stripes + F.col("stripe")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    deal = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    left = queries.select("cell", F.lit(0).alias("side"), F.col("query_id").cast("long").alias("id"), "embedding", F.col("floor").cast("double").alias("floor"), deal("query_id", blocks).alias("block"), every(stripes).alias("stripe"))
    right = vectors.select("cell", F.lit(1).alias("side"), F.col("chunk_id").cast("long").alias("id"), "embedding", F.lit(0.0).alias("floor"), every(blocks).alias("block"), deal("chunk_id", stripes).alias("stripe"))
    rows = left.unionByName(right).select(place.alias("place"), "side", "id", F.col("embedding").cast("array<float>").alias("embedding"), "floor")
    return rows.repartition("place").sortWithinPartitions("place", "side", "id").mapInArrow(partial(_best, d, k), FOUND)


def usual_length(vectors: DataFrame) -> int:
    """The commonest length of the vectors; of equally common ones the longest."""
    usual = vectors.filter("embedding IS NOT NULL").groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return usual["d"] if usual else 0


def _odd(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """Pairs of all that are given, by the expression."""
    pairs = against(vectors.select("chunk_id", "embedding"), queries.select("query_id", F.col("embedding").alias("_query")), "query_id")
    return pairs.select("query_id", "chunk_id", F.round(cosine(F.col("embedding"), F.col("_query")), 6).alias("score"))


def _with_odd(found: DataFrame, vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """found, and the pairs of vectors and queries of which one is not plain."""
    if not queries.filter("NOT plain").isEmpty():
        found = found.unionByName(_odd(vectors, queries.filter("NOT plain")))
    if not vectors.filter("NOT plain").isEmpty():
        found = found.unionByName(_odd(vectors.filter("NOT plain"), queries.filter("plain")))
    return found


def nearest(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, chunk_id, score, rank): the k best vectors(chunk_id long, embedding) of each of queries(query_id long, embedding), by cosine rounded to 6 decimals.

    Vectors and queries without id, of an uncommon length, zero, or with entries that are null or not finite are paired by the expression itself.
    """
    d = usual_length(vectors)
    vectors, queries = _plain(vectors.select("chunk_id", "embedding"), "chunk_id", d), _plain(queries.select("query_id", "embedding"), "query_id", d)
    cell = F.lit(0).alias("cell")
    found = grouped(vectors.filter("plain").select(cell, "*"), queries.filter("plain").select(cell, "*", F.lit(float("-inf")).alias("floor")), d, k)
    return top(_with_odd(found, vectors, queries), ["query_id"], "score", "chunk_id", k)


def nearest_in_cells(vectors: DataFrame, queries: DataFrame, k: int, bounds: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """`nearest` of vectors and queries with a `cell`: a query's own cell first, then those in which `bounds` lets a vector reach its k-th score.

    bounds: of the queries a row for each other cell (`probe`) with the highest cosine (`bound`) that a vector there can have.
    """
    d = usual_length(vectors)
    vectors, queries = _plain(vectors.select("cell", "chunk_id", "embedding"), "chunk_id", d), _plain(queries.select("cell", "query_id", "embedding"), "query_id", d)
    asked, right = queries.filter("plain"), vectors.filter("plain")
    own = kept(grouped(right, asked.withColumn("floor", F.lit(float("-inf"))), d, k))
    best = top(own, ["query_id"], "score", "chunk_id", k).groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).alias("floor"))
    # Similarities are rounded to 6 decimals; what may tie with the floor is probed too.
    floor = F.coalesce("floor", F.lit(float("-inf")))
    probes = kept(bounds(asked).join(best, "query_id", "left").filter(F.col("bound") >= floor - 2e-6).select(F.col("probe").alias("cell"), "query_id", "embedding", floor.alias("floor")))
    found = own.unionByName(grouped(right, probes, d, k))
    return top(_with_odd(found, vectors.filter("embedding IS NOT NULL"), queries), ["query_id"], "score", "chunk_id", k)


def classify(vectors: DataFrame, exemplars: DataFrame, threshold: float) -> DataFrame:
    """vec_id, topic and confidence: the topic of the most similar exemplar (topic, embedding), null under the threshold; ties go to the smaller topic."""
    asked = vectors.filter("embedding IS NOT NULL").select(F.col("vec_id").alias("query_id"), "embedding")
    first = nearest(exemplars.select(F.col("topic").cast("long").alias("chunk_id"), "embedding"), asked, 1)
    topic = F.col("chunk_id").cast(exemplars.schema["topic"].dataType)
    return first.select(F.col("query_id").alias("vec_id"), F.when(F.col("score") >= threshold, topic).alias("topic"), F.col("score").alias("confidence"))
