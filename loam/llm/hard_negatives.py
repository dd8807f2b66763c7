"""Hard-negative mining: for each anchor and positive the best-scoring rows of other labels within a share of the positive's score.

Scores are integer inner products. A coordinate is added to each vector, so that all have the length of the longest and an
inner product becomes a Euclidean distance: with M that length, |a - x|^2 = |a|^2 + M^2 - 2 a.x. Every row stores its
distances to `PIVOTS` rows, its pivot table; the triangle inequality over a pair's distances to the same
pivot then brackets their score from both sides. Only pairs whose bracket reaches into a window that is asked for are scored exactly.

Copies. Rows of one label and vector are one query if any of them is an anchor, and only their `POSITIVES` + 1
smallest ids can ever be returned; a group of copies of any size weighs as much as one row.

Blocks. Rows are dealt by ranges of label, nearest pivot, distance and id, which cuts hot groups anywhere, and packed into
blocks of `BLOCK` rows that carry their spans of labels and pivot distances; queries into blocks of `ASKED`. A block of queries
meets a block of rows when their labels allow it and their spans' bracket can reach the score that a query has already seen
in the block it came from. `GROUP` blocks of queries (a bounded number of rows) are broadcast at once and the row
blocks read once for each such group. A task keeps the best rows of each query over all blocks that it meets, and their scores narrow
the windows as it goes, so what leaves a task is a few rows a query, whatever it has read.

Two passes: the first finds each query's positives, the second, with windows set by their scores, its
negatives. What the queries of one group find is stored before the next is begun.

Defined results: rows with a null id, label or vector, an empty vector, or a null or non-finite component take no part, nor do
components so large that inner products might not fit a long (over sqrt(2^63 / length)). Rows that share an id
count as one, that of the smallest label, then vector. Vectors of different lengths never meet: each length is searched
by itself. An anchor is never its own positive. Positives that no row fits, negative scores among them, give
no rows; an empty table gives none. Other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lean, shared_dir, stored, table

# Scale of components, positives and negatives returned, the window in hundredths of the positive's score.
SCALE, POSITIVES, NEGATIVES, LEAST, MOST = 256, 5, 3, 50, 95
PIVOTS = 16
#: Rows of a block, queries of a block, blocks of queries that go to every task at once.
BLOCK, ASKED, GROUP = 2_048, 256, 64
#: Share of a pair of blocks' pairs from which all are scored by one matrix product.
DENSE = 0.1
LOWEST, HIGHEST = np.iinfo(np.int64).min, np.iinfo(np.int64).max

ROW = "vec_id long, label long, vec binary, norm2 long, asked boolean, distances binary, cell int, near double"
SPANS = "label_low long, label_high long, lows array<double>, highs array<double>"
PACKED = f"kind int, id long, {SPANS}, norm2 double, floor long, ids binary, labels binary, vecs binary, norms binary, distances binary, floors binary"
FOUND = "query_id long, place int, vec_id long, score long"


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, x array<long>, norm2) of the rows of vectors(vec_id, label, embedding) that take part, one an id."""
    sound = vectors.filter(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("embedding") > 0)
        & F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double") * SCALE) <= F.sqrt(F.lit(2.0**63) / F.size("embedding")) - 1) & (F.abs(c.cast("double") * SCALE) < 2.0**31 - 1))
    )
    whole = sound.select(F.col("vec_id").cast("long").alias("vec_id"), F.struct(F.col("label").cast("long").alias("label"), F.transform("embedding", lambda c: F.floor(c.cast("double") * SCALE)).alias("x")).alias("row"))
    return whole.groupBy("vec_id").agg(F.min("row").alias("row")).select("vec_id", "row.label", "row.x", F.aggregate("row.x", F.lit(0).cast("long"), lambda s, v: s + v * v).alias("norm2"))


def _numbers(column: pa.Array, kind: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


class Pivots:
    """What the workers need to measure distances: the pivots, in full length, and the longest length."""

    def __init__(self, rows: np.ndarray, longest: int):
        self.rows, self.longest, self.d = rows, float(longest), rows.shape[1]
        self.rest = np.sqrt(np.maximum(self.longest - (rows**2).sum(axis=1), 0))

    def of_rows(self, x: np.ndarray, norm2: np.ndarray) -> np.ndarray:
        """Distances of lengthened rows to the pivots."""
        rest = np.sqrt(np.maximum(self.longest - norm2, 0))
        return np.sqrt(np.maximum(2 * self.longest - 2 * (x @ self.rows.T + rest[:, None] * self.rest), 0))

    def of_queries(self, x: np.ndarray, norm2: np.ndarray) -> np.ndarray:
        """Distances of queries, whose added coordinate is zero, to the pivots."""
        return np.sqrt(np.maximum(norm2[:, None] + self.longest - 2 * x @ self.rows.T, 0))

    def slack(self, norm2: np.ndarray) -> np.ndarray:
        """What rounding of distances may cost a bracket, amply."""
        return 1e-6 * (norm2 + self.longest) + 1


def products(a: np.ndarray, b: np.ndarray, longest: float) -> np.ndarray:
    """Exact inner products of integer rows: in doubles where no sum can leave their whole numbers, else in longs."""
    if longest < 2**53:
        return (a.astype("f8") @ b.astype("f8").T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def leading(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row of scores its k highest and their ids (ids has the columns', or each entry's); ties to the smaller id. LOWEST is nothing."""
    if scores.shape[1] > 4 * k:
        least = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k]
        at, place = np.nonzero((scores >= least[:, None]) & (scores > LOWEST))
    else:
        at, place = np.nonzero(scores > LOWEST)
    values, names = scores[at, place], ids[place] if ids.ndim == 1 else ids[at, place]
    order = np.lexsort((names, -values, at))
    at, values, names = at[order], values[order], names[order]
    rank = np.arange(len(at)) - np.searchsorted(at, at)
    best, who = np.full((len(scores), k), LOWEST), np.zeros((len(scores), k), np.int64)
    use = rank < k
    best[at[use], rank[use]], who[at[use], rank[use]] = values[use], names[use]
    return best, who


def _deal(pivots: Pivots, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with their distances to the pivots and the nearest pivot."""
    for batch in batches:
        if not batch.num_rows:
            continue
        x = np.asarray(batch.column("x").flatten(), np.int64).reshape(-1, pivots.d)
        distances = pivots.of_rows(x.astype("f8"), np.asarray(batch.column("norm2"), "f8"))
        cell = distances.argmin(axis=1).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [batch.column("vec_id"), batch.column("label"), pa.array([v.tobytes() for v in x.astype("<i4")], pa.binary()), batch.column("norm2"), batch.column("asked"),
             pa.array([v.tobytes() for v in distances.astype("<f8")], pa.binary()), pa.array(cell), pa.array(distances[np.arange(len(x)), cell])],
            ["vec_id", "label", "vec", "norm2", "asked", "distances", "cell", "near"],
        )


def _packed(kind: int, ids: np.ndarray, labels: np.ndarray, vecs: np.ndarray, norms: np.ndarray, distances: np.ndarray, floors: np.ndarray, floor: int) -> dict:
    return {
        "kind": kind, "id": int(ids.min()), "label_low": int(labels.min()), "label_high": int(labels.max()), "lows": distances.min(axis=0).tolist(), "highs": distances.max(axis=0).tolist(),
        "norm2": float(norms.max()), "floor": floor, "ids": ids.astype("<i8").tobytes(), "labels": labels.astype("<i8").tobytes(), "vecs": vecs.astype("<i4").tobytes(),
        "norms": norms.astype("<f8").tobytes(), "distances": distances.astype("<f8").tobytes(), "floors": floors.astype("<i8").tobytes(),
    }


KINDS = {"kind": pa.int32(), "id": pa.int64(), "label_low": pa.int64(), "label_high": pa.int64(), "lows": pa.list_(pa.float64()), "highs": pa.list_(pa.float64()), "norm2": pa.float64(), "floor": pa.int64()} | dict.fromkeys(("ids", "labels", "vecs", "norms", "distances", "floors"), pa.binary())


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=pa.schema(list(KINDS.items())))


def _pack(pivots: Pivots, k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows as blocks (kind 0), and each query among them as a block of one (kind 1) with the k-th score it has seen here."""

    def block(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(parts).combine_chunks()
        col = lambda name: held.column(name).combine_chunks()
        ids, labels, norms = (np.asarray(col(n), kind) for n, kind in (("vec_id", "i8"), ("label", "i8"), ("norm2", "f8")))
        vecs, distances = _numbers(col("vec"), "<i4", pivots.d), _numbers(col("distances"), "<f8", len(pivots.rows))
        yield _batch([_packed(0, ids, labels, vecs, norms, distances, np.zeros(0), LOWEST)])
        asked = np.nonzero(np.asarray(col("asked")))[0]
        if len(asked):
            scores = np.where(labels[asked][:, None] == labels, products(vecs[asked], vecs, pivots.longest), LOWEST)
            floors = leading(scores, ids, k)[0][:, -1]
            own = pivots.of_queries(vecs[asked].astype("f8"), norms[asked])
            yield _batch([_packed(1, ids[i : i + 1], labels[i : i + 1], vecs[i : i + 1], norms[i : i + 1], own[j : j + 1], np.zeros(0), int(floors[j])) for j, i in enumerate(asked)])

    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        while batch.num_rows:
            room = BLOCK - sum(b.num_rows for b in waiting)
            waiting.append(batch.slice(0, room))
            batch = batch.slice(min(room, batch.num_rows))
            if sum(b.num_rows for b in waiting) == BLOCK:
                yield from block(waiting)
                waiting = []
    if waiting:
        yield from block(waiting)


FIELDS = (("ids", "<i8"), ("labels", "<i8"), ("vecs", "<i4"), ("norms", "<f8"), ("distances", "<f8"), ("floors", "<i8"))


def _join_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted queries, blocks of one, as blocks of ASKED; their floors are their windows (lowest and highest score of each)."""

    def joined(rows: list[dict]) -> pa.RecordBatch:
        parts = {name: np.frombuffer(b"".join(r[name] for r in rows), kind).reshape(len(rows), -1) for name, kind in FIELDS[:-1]}
        flat = [v if name in ("vecs", "distances") else v[:, 0] for name, v in parts.items()]
        windows = np.array([r["windows"] for r in rows], np.int64)
        low, high = windows[:, 0::2], windows[:, 1::2]
        return _batch([_packed(1, *flat, windows, int(np.where(low <= high, low, HIGHEST).min()))])

    waiting: list[dict] = []
    for batch in batches:
        waiting += batch.to_pylist()
        while len(waiting) >= ASKED:
            yield joined(waiting[:ASKED])
            waiting = waiting[ASKED:]
    if waiting:
        yield joined(waiting)


class Search:
    """The best rows of each query and window over the blocks that one task meets."""

    def __init__(self, pivots: Pivots, same: bool, k: int, windows: int):
        self.pivots, self.same, self.k, self.windows = pivots, same, k, windows
        self.held: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.met = self.scored = 0

    def arrays(self, batch: pa.RecordBatch, i: int, side: str, width: int) -> list[np.ndarray]:
        widths = {"vecs": self.pivots.d, "distances": len(self.pivots.rows), "floors": width}
        found = []
        for name, kind in FIELDS:
            a = np.frombuffer(batch.column(side + name)[i].as_py(), kind)
            found.append(a.reshape(-1, widths[name]) if name in widths and width else a)
        return found

    def meet(self, key: int, query: list[np.ndarray], rows: list[np.ndarray]) -> None:
        ids, labels, vecs, norms, distances, floors = query
        row_ids, row_labels, row_vecs, _, row_distances, _ = rows
        m, n = len(ids), len(row_ids)
        row_vecs, row_distances = row_vecs.reshape(n, -1), row_distances.reshape(n, -1)
        if key not in self.held:
            self.held[key] = ids, np.full((m, self.windows, self.k), LOWEST), np.zeros((m, self.windows, self.k), np.int64)
        _, best, who = self.held[key]
        low, high = np.maximum(floors[:, 0::2], best[:, :, -1]), floors[:, 1::2]
        open_ = low <= high
        bottom = np.where(open_, low, HIGHEST).min(axis=1)
        top = np.where(open_, high, LOWEST).max(axis=1)
        take = (labels[:, None] == row_labels) == self.same
        self.met += int(take.sum())
        least, most = np.zeros((m, n)), np.full((m, n), np.inf)
        for p in range(len(self.pivots.rows)):
            a, b = distances[:, p, None], row_distances[None, :, p]
            np.maximum(least, np.abs(a - b), out=least)
            np.minimum(most, a + b, out=most)
        reach, slack = (norms + self.pivots.longest)[:, None], self.pivots.slack(norms)[:, None]
        take &= ((reach - least**2) / 2 + slack >= bottom[:, None].astype("f8")) & ((reach - most**2) / 2 - slack <= top[:, None].astype("f8"))
        share = take.mean()
        if not share:
            return
        self.scored += int(take.sum())
        if share >= DENSE:
            scores = np.where(take, products(vecs, row_vecs, self.pivots.longest), LOWEST)
        else:
            scores = np.full((m, n), LOWEST)
            i, j = np.nonzero(take)
            kind = "f8" if self.pivots.longest < 2**53 else np.int64
            for at in range(0, len(i), 65_536):
                part = slice(at, at + 65_536)
                scores[i[part], j[part]] = np.einsum("ij,ij->i", vecs[i[part]].astype(kind), row_vecs[j[part]].astype(kind)).astype(np.int64)
        for w in range(self.windows):
            fits = np.where((scores >= low[:, w, None]) & (scores <= high[:, w, None]), scores, LOWEST)
            some = (fits > LOWEST).any(axis=1)
            if some.any():
                new, names = leading(fits[some], row_ids, self.k)
                best[some, w], who[some, w] = leading(np.hstack([best[some, w], new]), np.hstack([who[some, w], names]), self.k)

    def found(self) -> Iterator[pa.RecordBatch]:
        for ids, best, who in self.held.values():
            at, w, rank = np.nonzero(best > LOWEST)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(w.astype(np.int32)), pa.array(who[at, w, rank]), pa.array(best[at, w, rank])], ["query_id", "place", "vec_id", "score"])


def _search(pivots: Pivots, same: bool, k: int, windows: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    search = Search(pivots, same, k, windows)
    for batch in batches:
        for i in range(batch.num_rows):
            search.meet(batch.column("q_id")[i].as_py(), search.arrays(batch, i, "q_", 2 * windows), search.arrays(batch, i, "", 0))
    yield from search.found()


def _reaches(pivots: Pivots, same: bool) -> Column:
    """Whether some pair of a block of queries (q_) and a block of rows may count, by their spans."""
    near = lambda p: F.greatest(F.get("q_lows", p) - F.get("highs", p), F.get("lows", p) - F.get("q_highs", p), F.lit(0.0))
    least = F.array_max(F.transform(F.sequence(F.lit(0), F.lit(len(pivots.rows) - 1)), near))
    score = (F.col("q_norm2") + pivots.longest - least * least) / 2 + 1e-6 * (F.col("q_norm2") + pivots.longest) + 1
    one = lambda side: F.col(f"{side}label_low") == F.col(f"{side}label_high")
    overlap = (F.col("label_low") <= F.col("q_label_high")) & (F.col("label_high") >= F.col("q_label_low"))
    labels = overlap if same else ~(one("") & one("q_") & (F.col("label_low") == F.col("q_label_low")))
    return labels & (score >= F.col("q_floor"))


def search(blocks: DataFrame, queries: DataFrame, pivots: Pivots, same: bool, k: int, windows: int) -> DataFrame:
    """(query_id, place, vec_id, score, rank): of each query and window the k best rows of its own label, or of others."""
    spark = blocks.sparkSession
    groups = max(1, -(-queries.count() // GROUP))
    path = f"{shared_dir(spark)}/loam/scores-{uuid.uuid4().hex}"
    for g in range(groups):
        part = queries.filter(F.pmod(F.xxhash64("id"), F.lit(groups)) == g) if groups > 1 else queries
        part = part.select(*(F.col(c).alias(f"q_{c}") for c in part.columns if c != "kind"))
        pairs = blocks.join(F.broadcast(part), _reaches(pivots, same))  # at most about GROUP * ASKED queries
        pairs.mapInArrow(partial(_search, pivots, same, k, windows), FOUND).write.mode("append").parquet(path)
    rank = F.row_number().over(Window.partitionBy("query_id", "place").orderBy(F.desc("score"), "vec_id"))
    return stored(spark.read.schema(FOUND).parquet(path).withColumn("rank", rank).filter(F.col("rank") <= k), "best")


def _windows(scores: Column, least: int, most: int) -> Column:
    """Lowest and highest score of each positive's window, as one array; empty windows are the wrong way round."""
    tens = lambda s: ((s - F.pmod(s, F.lit(100))).cast("decimal(20,0)") / 100).cast("long")
    low = lambda s: tens(s) * least + F.ceil(F.pmod(s, F.lit(100)) * least / 100)
    high = lambda s: tens(s) * most + F.floor(F.pmod(s, F.lit(100)) * most / 100)
    return F.flatten(F.transform(scores, lambda s: F.array(low(s), high(s))))


def _of_one_length(rows: DataFrame, anchors: Column, positives: int, negatives: int, least: int, most: int) -> DataFrame:
    spark, listed = rows.sparkSession, positives + 1
    keyed = rows.select("*", F.xxhash64("x").alias("t1"), F.xxhash64(F.lit(1), "x").alias("t2"))
    same = ["label", "t1", "t2"]
    asked = stored(keyed.filter(anchors).select(F.col("vec_id").alias("anchor_id"), *same), "anchors")
    copy = F.row_number().over(Window.partitionBy(*same).orderBy("vec_id"))
    candidates = keyed.withColumn("copy", copy).filter(F.col("copy") <= max(listed, negatives))
    marked = candidates.join(asked.select(*same).distinct().withColumn("hit", F.lit(True)), same, "left").withColumn("asked", F.col("hit").isNotNull() & (F.col("copy") == 1))
    marked = stored(marked.select("vec_id", *same, "x", "norm2", "asked"), "candidates")
    chosen = marked.orderBy(F.xxhash64(F.lit("pivot"), "vec_id")).limit(PIVOTS).select("x").collect()
    if not chosen:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    pivots = Pivots(np.array([r["x"] for r in chosen], "f8"), marked.agg(F.max("norm2")).first()[0])
    order = ["label", "cell", "near", "vec_id"]
    dealt = marked.select("vec_id", "label", "x", "norm2", "asked").mapInArrow(partial(_deal, pivots), ROW).repartitionByRange(*order).sortWithinPartitions(*order)
    packed = stored(dealt.mapInArrow(partial(_pack, pivots, listed), PACKED), "pivot-table")
    blocks, single = packed.filter("kind = 0"), packed.filter("kind = 1")
    by = ["label_low", "lows", "id"]

    def grouped(windows: Column, queries: DataFrame) -> DataFrame:
        """Blocks of queries with `windows`, an array<long> of lowest and highest scores."""
        return stored(queries.withColumn("windows", windows).repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(_join_queries, PACKED), "queries")

    first = grouped(F.array(F.col("floor"), F.lit(HIGHEST)), single)
    kin = search(blocks, first, pivots, True, listed, 1).select("query_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), (F.col("rank") - 1).alias("place"))
    scores = kin.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("place", "positive_score"))).alias("kin"))  # `listed` entries at most
    padded = F.transform(F.sequence(F.lit(0), F.lit(listed - 1)), lambda i: F.coalesce(F.get("kin", i)["positive_score"], F.lit(-100).cast("long")))
    second = grouped(_windows(padded, least, most), single.join(scores, F.col("id") == F.col("query_id")))
    others = search(blocks, second, pivots, False, negatives, listed).select("query_id", "place", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    names = marked.filter("asked").select(F.col("vec_id").alias("query_id"), *same)
    own = asked.join(names, same).join(kin, "query_id").filter("positive_id <> anchor_id")
    nth = F.row_number().over(Window.partitionBy("anchor_id").orderBy("place"))
    own = own.withColumn("nth", nth).filter(F.col("nth") <= positives)
    return own.join(others, ["query_id", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def hard_negatives(vectors: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, most: int = MOST) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the rows of vectors(vec_id, label, embedding) that meet `anchors`."""
    spark = vectors.sparkSession
    rows = stored(usable(vectors.select("vec_id", "label", "embedding")), "rows")
    lengths = sorted(r[0] for r in rows.select(F.size("x")).distinct().collect()) or [0]
    with lean(spark):
        found = [_of_one_length(rows.filter(F.size("x") == d), anchors, positives, negatives, least, most) for d in lengths]
    return reduce(DataFrame.unionByName, found)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"), "embedding")
    return hard_negatives(rows, F.col("vec_id") % 50 == 0)


OP11_SQL = f"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x : floor({SCALE} * x::DOUBLE)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x : x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS kin, list_inner_product(a.x, r.x)::BIGINT AS score FROM v a JOIN v r ON a.vec_id <> r.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS k FROM s WHERE kin) WHERE k <= {POSITIVES}),
n AS (SELECT p.*, vec_id AS negative_id, score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT kin AND {LEAST} * positive_score <= 100 * score AND 100 * score <= {MOST} * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {NEGATIVES}
"""
