"""Quality classifier: random-indexing word vectors, pooled per document, and a small network.

Tokens (runs of letters, of digits, of other visible characters; case kept) fall into a fixed number of
hash buckets. Every bucket has a sparse random index vector; its word vector is the sum of the index
vectors of its neighbours within `REACH` tokens over all documents, scaled to length 1. A document's
features are the mean word vector and the mean index vector of its tokens, and the shares of tokens equal
to the one before and to the one before that. A two-layer numpy network,
trained on a bounded random sample of labelled documents, gives a logit; a temperature fitted on a part
of the sample kept out of training turns it into a calibrated probability.

The sums are whole numbers, so the word vectors don't depend on the order of the work. Memory is bounded
by the number of buckets, not by the vocabulary.

Defined results: null and empty texts have zero features and get the network's score for these. Without
labels of both classes every score is the share of label 1, or 0.5 without labels. Several labels of a
doc_id are averaged, ties count as 1; null labels don't count. Repeated rows are scored one by one; extra
columns are ignored; texts are read whole; without documents there are no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, lean_batches, spread_table, table

BUCKETS = 16_384
DIM = 32
REACH = 2
NONZERO = 4
BLOCK = 256
#: Labelled documents at most in the training sample; the rest of the corpus still shapes the word vectors.
SAMPLE = 20_000
HIDDEN = 32
EPOCHS = 300
SEED = 17
CHUNK = 1 << 17
TOKEN = r"\p{L}+|\p{N}+|[^\p{L}\p{N}\s]+"


def tokens(text: Column) -> Column:
    """Hash buckets of a text's tokens."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))
    return F.transform(found, lambda t: F.pmod(F.xxhash64(t), F.lit(BUCKETS)).cast("int"))


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places (BUCKETS x NONZERO) and signs of the nonzero entries of each bucket's index vector."""
    rng = np.random.default_rng(SEED)
    places = np.argsort(rng.random((BUCKETS, DIM)), axis=1)[:, :NONZERO]
    return places.astype(np.int64), rng.choice([-1.0, 1.0], (BUCKETS, NONZERO))


def dense_index_vectors() -> np.ndarray:
    places, signs = index_vectors()
    full = np.zeros((BUCKETS, DIM), np.float32)
    np.put_along_axis(full, places, signs.astype(np.float32), axis=1)
    return full / np.sqrt(NONZERO)


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """All values of a list column, and the row of each."""
    return np.asarray(column.flatten()), np.repeat(np.arange(len(column)), np.asarray(column.value_lengths()))


def context_sums(ids: np.ndarray, rows: np.ndarray, at: int, places: np.ndarray, signs: np.ndarray, sums: np.ndarray) -> None:
    """Add to sums the index vectors of neighbours in the same row, for pairs that begin in [at, at + CHUNK)."""
    for reach in range(1, REACH + 1):
        stop = max(min(at + CHUNK, len(ids) - reach), at)
        same = rows[at:stop] == rows[at + reach : stop + reach]
        left, right = ids[at:stop][same].astype(np.int64), ids[at + reach : stop + reach][same].astype(np.int64)
        for word, other in ((left, right), (right, left)):
            for k in range(NONZERO):
                sums += np.bincount(word * DIM + places[other, k], signs[other, k], minlength=len(sums))


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Word vectors of all buckets from all of docs(text).

    Tasks add up their own documents; the partial sums, in blocks of buckets, are added in two rounds,
    so that no task reads those of all tasks.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, signs = index_vectors()
        sums = np.zeros(BUCKETS * DIM)
        for batch in batches:
            for part in _parts(batch.column("_tokens")):
                ids, rows = _flat(part)
                for at in range(0, len(ids), CHUNK):
                    context_sums(ids, rows, at, places, signs, sums)
        give_back()
        yield from emit({b: part for b, part in enumerate(sums.astype(np.int64).reshape(-1, BLOCK * DIM)) if part.any()})

    def emit(blocks: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        names = ["block", "sums"]
        yield pa.RecordBatch.from_arrays([pa.array(list(blocks), pa.int32()), pa.array([x.tobytes() for x in blocks.values()], pa.binary())], names)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, part in zip(batch.column("block").to_pylist(), batch.column("sums"), strict=True):
                values = np.frombuffer(part.as_buffer(), np.int64)
                blocks[block] = blocks[block] + values if block in blocks else values
        yield from emit(blocks)

    lean_batches(docs.sparkSession)
    schema = "block int, sums binary"
    parts = docs.select(tokens(F.col("text")).alias("_tokens")).mapInArrow(partial, schema)
    some = parts.withColumn("salt", F.pmod(F.xxhash64("sums"), F.lit(16))).repartition("block", "salt").select("block", "sums").mapInArrow(add, schema)
    whole = some.repartition("block").mapInArrow(add, schema).collect()
    vectors = np.zeros((BUCKETS, DIM))
    for block, part in whole:
        vectors.reshape(-1, BLOCK * DIM)[block] = np.frombuffer(bytes(part), np.int64)
    lengths = np.linalg.norm(vectors, axis=1, keepdims=True)
    return (vectors / np.where(lengths > 0, lengths, 1)).astype(np.float32)


def _parts(column: pa.ListArray) -> Iterator[pa.ListArray]:
    """Slices of a list column with about CHUNK values each, so that work on one fits in little memory."""
    groups = np.cumsum(np.asarray(column.value_lengths())) // CHUNK
    edges = np.flatnonzero(np.diff(groups, prepend=-1, append=-1))
    return (column.slice(a, b - a) for a, b in zip(edges, edges[1:], strict=False))


def document_features(column: pa.ListArray, vectors: np.ndarray) -> np.ndarray:
    """Features of each row of a list column of tokens."""
    found = [pooled(*_flat(part), len(part), vectors).astype(np.float32) for part in _parts(column)]
    return np.concatenate(found) if found else np.zeros((0, vectors.shape[1] + 2), np.float32)


def pooled(ids: np.ndarray, rows: np.ndarray, n: int, vectors: np.ndarray) -> np.ndarray:
    """Mean vector and shares of repeated tokens of each of n rows; zero for rows without tokens."""
    out = np.zeros((n, vectors.shape[1]))
    for at in range(0, len(ids), CHUNK // 8):
        part, of = ids[at : at + CHUNK // 8], rows[at : at + CHUNK // 8]
        starts = np.flatnonzero(np.diff(of, prepend=-1))
        out[of[starts]] += np.add.reduceat(vectors[part], starts, axis=0)
    counts = np.maximum(np.bincount(rows, minlength=n), 1)
    repeats = [np.bincount(rows[lag:], (ids[lag:] == ids[:-lag]) & (rows[lag:] == rows[:-lag]), minlength=n) / counts for lag in (1, 2)]
    return np.column_stack([out / counts[:, None], *repeats])


def features(docs: DataFrame, keep: list[str], vectors: np.ndarray) -> DataFrame:
    """Columns of `keep` and the features of docs(text, *keep) as 32-bit floats in a binary column."""
    schema = docs.select(*keep).schema.add("features", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = np.hstack([vectors, dense_index_vectors()])
        for batch in batches:
            found = document_features(batch.column("_tokens"), both)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array([x.tobytes() for x in found], pa.binary())], schema.names)
        give_back()

    return docs.select(*keep, tokens(F.col("text")).alias("_tokens")).mapInArrow(run, schema)


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]
    temperature: float = 1.0
    constant: float | None = None

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        return np.tanh((x - self.mean) / self.scale @ w1 + b1) @ w2 + b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -50, 50)))


def fit(x: np.ndarray, y: np.ndarray) -> Network:
    """Train on four fifths of (x, y) by Adam; fit the temperature on the rest."""
    mean, scale = x.mean(axis=0) if len(x) else 0.0, x.std(axis=0) + 1e-6 if len(x) else 1.0
    if len(set(y.tolist())) < 2:
        return Network(mean, scale, [], constant=float(y.mean()) if len(y) else 0.5)
    rng = np.random.default_rng(SEED)
    order = rng.permutation(len(x))
    held = order[: len(x) // 5]
    kept = order[len(held) :]
    weights = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    net = Network(mean, scale, weights)
    z, t = (x[kept] - mean) / scale, y[kept]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for step in range(1, EPOCHS + 1):
        w1, b1, w2, b2 = weights
        hidden = np.tanh(z @ w1 + b1)
        error = (1 / (1 + np.exp(-np.clip(hidden @ w2 + b2, -50, 50))) - t) / len(t)
        back = np.outer(error, w2) * (1 - hidden**2)
        slopes = [z.T @ back + 1e-4 * w1, back.sum(axis=0), hidden.T @ error + 1e-4 * w2, np.array([error.sum()])]
        for i, slope in enumerate(slopes):
            first[i] = 0.9 * first[i] + 0.1 * slope
            second[i] = 0.999 * second[i] + 0.001 * slope**2
            weights[i] -= 0.02 * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    if len(held):
        logits, truth = net.logits(x[held]), y[held]
        choices = np.geomspace(0.25, 8, 41)
        loss = [np.logaddexp(0, np.where(truth == 1, -1, 1) * logits / t).mean() for t in choices]
        net.temperature = float(choices[int(np.argmin(loss))])
    return net


def train(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, Network]:
    """Word vectors from all of docs(doc_id, text), a network from labels(doc_id, quality)."""
    vectors = word_vectors(docs)
    truth = labels.filter(F.col("quality").isNotNull()).groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
    sample = truth.orderBy(F.xxhash64(F.lit("quality"), "doc_id"), "doc_id").limit(SAMPLE)
    described = features(docs.join(F.broadcast(sample), "doc_id"), ["doc_id", "label"], vectors).select("features", "label", "doc_id").distinct()
    rows = described.orderBy(F.xxhash64(F.lit("rows"), "doc_id", "features"), "doc_id").limit(SAMPLE).collect()  # an id may have any number of texts
    rows.sort(key=lambda r: (r["doc_id"], bytes(r["features"])))
    x = np.array([np.frombuffer(bytes(r["features"]), np.float32) for r in rows], np.float64).reshape(len(rows), 2 * DIM + 2)
    return vectors, fit(x, np.array([r["label"] for r in rows], np.float64))


def score(docs: DataFrame, keep: list[str], vectors: np.ndarray, net: Network) -> DataFrame:
    """Columns of `keep` and score (6 decimals) of docs(text, *keep)."""

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        both = np.hstack([vectors, dense_index_vectors()])
        for column in columns:
            yield pa.array(np.round(net.scores(document_features(column, both).astype(np.float64)), 6), pa.float64())
        give_back()

    lean_batches(docs.sparkSession)
    return docs.select(*keep, F.arrow_udf(run, "double")(tokens(F.col("text"))).alias("score"))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread_table(spark, sf_dir, "documents", "doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(~held_out(F.col("doc_id")))
    vectors, net = train(docs, labels)
    scored = score(docs.withColumn("held_out", held_out(F.col("doc_id"))), ["doc_id", "held_out"], vectors, net)
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_rejected(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows that score under 0.5, trained on labels(doc_id, quality); columns unchanged."""
    vectors, net = train(docs.select("doc_id", "text"), labels)
    scored = score(docs.select(F.struct("*").alias("_row"), "text"), ["_row"], vectors, net)
    return scored.filter("score >= 0.5").select("_row.*")
