"""Approximate nearest neighbours: a neighbour graph by NN-descent, greedy search over it.

Copies. Equal vectors are one node of the graph; the smallest ids of each group of copies are kept beside
it, as many as a result can need, so a group of copies of any size weighs as much as one vector.

Building. Vectors are first dealt to the cells of their nearest pivots (a bounded random sample); cells
are worked through in blocks, and each vector keeps the `DEGREE` nearest others that it met. Then each
round joins the graph with itself: at every vector its neighbours and those it is a neighbour of come
together, and each is offered the nearest of the others that improve its list. Rounds go on, at any size,
until few entries change. Hubs are cut into blocks that all hold the hub's own neighbours, so no reverse
neighbour is dropped. A vector is linked with its neighbours and with the nearest ones that list it.

Searching. Each query enters at its own node's links, if it is a node, and at a bounded random sample. It
holds a pool of the `POOL` nearest vectors seen; a hop joins the neighbours of pool members that are new to
it with the graph, measures them, and renews the pools of all queries. A query ends when no pool member is
new. Every hop ends in a stored table; no query goes through the driver.

Graph distances use single precision on vectors less their mean; scores are Euclidean distances of the original vectors in double
precision. Recall at 10 against brute force is given in the README.

Defined results: ties go to the smaller vec_id, among copies exactly. Vectors that are null, zero, of another length than most, or hold null or non-finite
components take no part; nor do null vec_ids. Rows that share a vec_id count as one (the smallest
vector). With fewer candidates than asked for, all are returned; an empty table gives no rows. Extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, stored, table

DEGREE = 24
#: Cells that a vector is dealt to, about how many vectors a cell has, how many pivots at most.
CELLS, CELL, MAX_PIVOTS = 6, 600, 4_096
#: Vectors in a block of a cell, and members of a block of a hub, at most about.
BLOCK = 1_200
OFFERS = 4
#: Share of all list entries under which the entries that a round changes end the rounds.
SETTLED = 0.02
POOL = 400
STARTS = 256
SMALL = 200_000


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, vec): the vectors that take part, as little-endian doubles in a binary column; stored."""
    sound = vectors.filter(
        F.col("vec_id").isNotNull()
        & F.col("embedding").isNotNull()
        & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("embedding", lambda x: x != 0)
    )
    usual = sound.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    sound = sound.filter(F.size("embedding") == (usual["n"] if usual else 0))
    single = sound.groupBy("vec_id").agg(F.min(F.transform("embedding", lambda x: x.cast("double"))).alias("embedding"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [np.asarray(x.values).astype("<f8").tobytes() for x in batch.column("embedding")]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(packed, pa.binary())], ["vec_id", "vec"])

    return stored(single.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(pack, "vec_id long, vec binary"), "vectors")


class Nodes(NamedTuple):
    vectors: DataFrame  # vec_id (the smallest of the copies), vec, t1, t2
    members: DataFrame  # t1, t2, vec_id: the smallest ids of each group of copies


def same_vector(vec: Column) -> list[Column]:
    return [F.xxhash64(vec).alias("t1"), F.xxhash64(F.lit(1), vec).alias("t2")]


def collapsed(vectors: DataFrame, k: int) -> Nodes:
    """Nodes of the different ones of vectors(vec_id, vec), with up to k + 1 ids of each."""
    keyed = vectors.select("vec_id", "vec", *same_vector(F.col("vec")))
    place = F.row_number().over(Window.partitionBy("t1", "t2").orderBy("vec_id"))
    ranked = stored(keyed.withColumn("place", place).filter(F.col("place") <= k + 1), "copies")
    return Nodes(ranked.filter("place = 1").drop("place"), ranked.select("t1", "t2", "vec_id"))


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), kind).reshape(len(rows), -1)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a and b, in single precision."""
    return np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * a @ b.T, 0)


def _by_group(batches: Iterator[pa.RecordBatch], keys: list[str], work: Callable[[list[dict]], Iterator[tuple]], kinds: list[pa.DataType], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Apply work to the rows of each key of sorted batches; a task holds one key's rows at a time."""
    held: list[dict] = []
    current = None
    found: list[tuple] = []
    for batch in batches:
        for row in batch.to_pylist():
            key = tuple(row[k] for k in keys)
            if key != current and held:
                found += work(held)
                held = []
            current = key
            held.append(row)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names)
            found = []
    if held and (found := list(work(held))):
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names)


LISTS = ["node", "ids", "dists", "fresh"]
LIST_KINDS = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float32()), pa.bool_()]
LIST_SCHEMA = "node long, ids array<long>, dists array<float>, fresh boolean"


def _nearest(ids: np.ndarray, distances: np.ndarray, count: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each row of distances the ids and distances of its nearest columns; infinite ones don't count."""
    count = min(count, distances.shape[1])
    near = np.argpartition(distances, count - 1, axis=1)[:, :count]
    for row, places in zip(distances, near, strict=True):
        places = places[np.isfinite(row[places])]
        yield ids[places], row[places]


def centring(vectors: DataFrame) -> Callable[[np.ndarray], np.ndarray]:
    """What brings vectors to single precision: one factor for all, and their mean taken off."""

    def largest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([float(np.abs(_matrix(batch.column("vec"), "<f8")).max())])], ["top"])

    top = vectors.select("vec").mapInArrow(largest, "top double").agg(F.max("top")).first()[0] or 1.0

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = 0.0, 0
        for batch in batches:
            if batch.num_rows:
                total, n = total + (_matrix(batch.column("vec"), "<f8") / top).sum(axis=0), n + batch.num_rows
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([n], pa.int64())], ["total", "n"])

    parts = vectors.select("vec").mapInArrow(sums, "total binary, n long").collect()
    mean = sum(np.frombuffer(bytes(r["total"]), "<f8") for r in parts) / max(1, sum(r["n"] for r in parts))
    return lambda x: (x / top - mean).astype("<f4")


def first_lists(vectors: DataFrame, n: int, single: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Neighbour lists (node, ids, dists, fresh) from the blocks of the pivots' cells; several a node."""
    wanted = int(min(MAX_PIVOTS, max(1, -(-n * CELLS // CELL))))
    pivots = vectors.orderBy(F.xxhash64(F.lit("pivot"), "vec_id")).limit(wanted).collect()
    places = single(np.array([np.frombuffer(bytes(r["vec"]), "<f8") for r in pivots]))
    cells = min(CELLS, len(places))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = single(_matrix(batch.column("vec"), "<f8"))
            near = np.argpartition(_distances(x, places), cells - 1, axis=1)[:, :cells].astype(np.int32)
            short = [v.tobytes() for v in x]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(short, pa.binary()), pa.array(list(near), pa.list_(pa.int32()))], ["vec_id", "vec", "cells"])

    dealt = vectors.mapInArrow(deal, "vec_id long, vec binary, cells array<int>").select("vec_id", "vec", F.explode("cells").alias("cell"))
    dealt = stored(dealt, "cells")
    sizes = stored(dealt.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")), "cell-sizes")
    blocks = dealt.join(broadcast_if_small(sizes, SMALL), "cell").withColumn("block", F.pmod(F.xxhash64("vec_id", "cell"), "blocks"))

    def work(rows: list[dict]) -> Iterator[tuple]:
        ids = np.array([r["vec_id"] for r in rows])
        x = np.frombuffer(b"".join(r["vec"] for r in rows), "<f4").reshape(len(rows), -1)
        distances = _distances(x, x)
        np.fill_diagonal(distances, np.inf)
        for node, (near, dists) in zip(ids, _nearest(ids, distances, DEGREE), strict=True):
            yield int(node), near, dists, True

    keys = ["cell", "block"]
    ordered = blocks.repartition(*keys).sortWithinPartitions(*keys).select("cell", "block", "vec_id", "vec")
    return ordered.mapInArrow(lambda b: _by_group(b, keys, work, LIST_KINDS, LISTS), LIST_SCHEMA)


def merged_lists(lists: DataFrame) -> DataFrame:
    """One list a node: node, ids, dists (nearest first), fresh (of each entry)."""
    kinds = [*LIST_KINDS[:3], pa.list_(pa.bool_())]

    def work(rows: list[dict]) -> Iterator[tuple]:
        known: dict[int, tuple[float, bool]] = {}
        for row in sorted(rows, key=lambda r: isinstance(r["fresh"], bool)):
            flags = row["fresh"] if isinstance(row["fresh"], list) else [row["fresh"]] * len(row["ids"])
            for other, dist, fresh in zip(row["ids"], row["dists"], flags, strict=True):
                known.setdefault(other, (dist, fresh))
        best = sorted((dist, other, fresh) for other, (dist, fresh) in known.items() if other != rows[0]["node"])[:DEGREE]
        yield rows[0]["node"], [b[1] for b in best], [b[0] for b in best], [b[2] for b in best]

    ordered = lists.repartition("node").sortWithinPartitions("node", F.desc("old"))
    return ordered.mapInArrow(lambda b: _by_group(b, ["node"], work, kinds, LISTS), "node long, ids array<long>, dists array<float>, fresh array<boolean>")


def _as_merged(lists: DataFrame, old: bool) -> DataFrame:
    """Lists with `fresh` as an array, marked as the graph's own (old) or offered."""
    flags = F.col("fresh") if old else F.transform("ids", lambda _: F.lit(True))
    return lists.select("node", "ids", "dists", flags.alias("fresh"), F.lit(old).alias("old"))


def descend(graph: DataFrame, short: DataFrame) -> DataFrame:
    """Offers (node, ids, dists, fresh) from one round of joining neighbours of neighbours."""
    edges = graph.select("node", F.explode(F.arrays_zip("ids", "fresh")).alias("e")).select("node", F.col("e.ids").alias("other"), F.col("e.fresh").alias("fresh"))
    limit = graph.select(F.col("node").alias("member"), F.coalesce(F.try_element_at("dists", F.lit(DEGREE)), F.lit(float("inf"))).alias("limit"))
    card = short.join(limit, "member")
    hubs = stored(edges.groupBy("other").agg(F.ceil(F.count("*") / (BLOCK // 2)).alias("blocks")).filter("blocks > 1").withColumnRenamed("other", "centre"), "hubs")
    hubs = broadcast_if_small(hubs, SMALL)
    blocks = F.coalesce("blocks", F.lit(1).cast("long"))
    inward = edges.select(F.col("other").alias("centre"), F.col("node").alias("member"), "fresh").join(hubs, "centre", "left")
    inward = inward.select("centre", "member", "fresh", F.pmod(F.xxhash64("member", "centre"), blocks).alias("block"))
    outward = edges.select(F.col("node").alias("centre"), F.col("other").alias("member"), "fresh").join(hubs, "centre", "left")
    outward = outward.select("centre", "member", "fresh", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("block"))
    members = inward.unionByName(outward).join(card, "member")

    def work(rows: list[dict]) -> Iterator[tuple]:
        unique: dict[int, dict] = {}
        for row in rows:
            if row["member"] not in unique or row["fresh"]:
                unique[row["member"]] = row
        chosen = list(unique.values())
        fresh = np.array([r["fresh"] for r in chosen])
        if len(chosen) < 2 or not fresh.any():
            return
        ids = np.array([r["member"] for r in chosen])
        x = np.frombuffer(b"".join(r["vec"] for r in chosen), "<f4").reshape(len(chosen), -1)
        distances = _distances(x, x)
        np.fill_diagonal(distances, np.inf)
        distances[~(fresh[:, None] | fresh[None])] = np.inf
        distances[distances >= np.array([r["limit"] for r in chosen])[:, None]] = np.inf
        for node, (near, dists) in zip(ids, _nearest(ids, distances, OFFERS), strict=True):
            if len(near):
                yield int(node), near, dists, True

    keys = ["centre", "block"]
    ordered = members.repartition(*keys).sortWithinPartitions(*keys).select(*keys, "member", "fresh", "vec", "limit")
    return ordered.mapInArrow(lambda b: _by_group(b, keys, work, LIST_KINDS, LISTS), LIST_SCHEMA)


def shortened(vectors: DataFrame, single: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(member, vec) of vectors in single precision."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                short = single(_matrix(batch.column("vec"), "<f8"))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array([x.tobytes() for x in short], pa.binary())], ["member", "vec"])

    return vectors.select("vec_id", "vec").mapInArrow(run, "member long, vec binary")


def build_graph(vectors: DataFrame) -> DataFrame:
    """(node, vec, links) of vectors(vec_id, vec), of which no two are equal: the searchable graph; stored."""
    n = vectors.count()
    single = centring(vectors)
    graph = stored(merged_lists(_as_merged(first_lists(vectors.select("vec_id", "vec"), n, single), False)), "graph")
    short = stored(shortened(vectors, single), "short-vectors")
    changed = n * DEGREE
    while changed > SETTLED * n * DEGREE:
        offers = _as_merged(descend(graph, short), False)
        old = graph.withColumn("fresh", F.transform("ids", lambda _: F.lit(False)))
        graph = stored(merged_lists(_as_merged(old, True).unionByName(offers)), "graph")
        changed = graph.agg(F.sum(F.size(F.filter("fresh", lambda x: x)))).first()[0] or 0
    edges = graph.select("node", F.explode(F.arrays_zip("ids", "dists")).alias("e")).select("node", F.col("e.ids").alias("other"), F.col("e.dists").alias("dist"))
    nearest = Window.partitionBy("other").orderBy("dist", "node")
    inward = edges.withColumn("rank", F.row_number().over(nearest)).filter(F.col("rank") <= DEGREE).groupBy("other").agg(F.collect_set("node").alias("back"))
    linked = graph.join(inward, F.col("node") == F.col("other"), "left").select("node", F.array_union("ids", F.coalesce("back", F.array().cast("array<long>"))).alias("links"))
    found = vectors.join(linked, F.col("vec_id") == F.col("node"), "left")
    return stored(found.select(F.col("vec_id").alias("node"), "vec", F.coalesce("links", F.array().cast("array<long>")).alias("links")), "links")


POOL_NAMES = ["query_id", "node", "vec", "dist", "links", "kind"]
POOL_SCHEMA = "query_id long, node long, vec binary, dist double, links array<long>, kind int"
POOL_KINDS = [pa.int64(), pa.int64(), pa.binary(), pa.float64(), pa.list_(pa.int64()), pa.int32()]
#: Kinds of rows of a pool: the query itself with its vector, vectors measured before, vectors just met.
QUERY, SEEN, MET = 0, 1, 2


def renewed(rows: list[dict]) -> Iterator[tuple]:
    """The rows of a query's next pool: the query, and the POOL nearest vectors with those links of new ones that it has not met."""
    query = next((r for r in rows if r["kind"] == QUERY), None)
    if query is None:
        return
    best = {r["node"]: (r["dist"], r["node"], ()) for r in rows if r["kind"] == SEEN}
    met = list({r["node"]: r for r in rows if r["kind"] == MET and r["node"] not in best and r["node"] != query["query_id"]}.values())
    if met:
        x = np.frombuffer(b"".join(r["vec"] for r in met), "<f8").reshape(len(met), -1)
        dists = np.sqrt(((x - np.frombuffer(query["vec"], "<f8")) ** 2).sum(axis=1))
        best |= {r["node"]: (d, r["node"], r["links"]) for r, d in zip(met, dists.tolist(), strict=True)}
    known = set(best) | {query["query_id"]}
    yield query["query_id"], query["node"], query["vec"], None, [], QUERY
    for dist, node, links in sorted(best.values())[:POOL]:
        fresh = [x for x in links if x not in known]
        known.update(fresh)
        yield query["query_id"], node, None, dist, fresh, SEEN


def search(graph: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, vec_id, score): the k nearest nodes, other than its own, of each of queries(query_id, vec)."""
    spark = graph.sparkSession
    starts = [r[0] for r in graph.select("node").orderBy(F.xxhash64(F.lit("start"), "node")).limit(STARTS).collect()]
    everyone = F.array(*map(F.lit, starts)).cast("array<long>")
    own = queries.join(graph.select(F.col("node").alias("query_id"), "links"), "query_id", "left")
    first = own.select("query_id", F.col("query_id").alias("node"), "vec", F.lit(None).cast("double").alias("dist"), F.array_union(F.coalesce("links", F.array().cast("array<long>")), everyone).alias("links"), F.lit(QUERY).alias("kind"))
    pool = stored(first, "pool")
    todo = pool.select("query_id", F.explode("links").alias("node")).filter("query_id <> node")
    while not todo.isEmpty():
        met = todo.join(graph, "node").select("query_id", "node", "vec", F.lit(None).cast("double").alias("dist"), "links", F.lit(MET).alias("kind"))
        rows = pool.withColumn("links", F.array().cast("array<long>")).unionByName(met)
        ordered = rows.repartition("query_id").sortWithinPartitions("query_id").select(*POOL_NAMES)
        pool = stored(ordered.mapInArrow(lambda b: _by_group(b, ["query_id"], renewed, POOL_KINDS, POOL_NAMES), POOL_SCHEMA), "pool")
        todo = pool.select("query_id", F.explode("links").alias("node"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("dist", "node"))
    nearest = pool.filter(F.col("kind") == SEEN).withColumn("rank", rank).filter(F.col("rank") <= k)
    return nearest.select("query_id", F.col("node").alias("vec_id"), F.col("dist").alias("score"))


def neighbours(vectors: DataFrame, asked: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest others of those of vectors(vec_id, vec) whose ids asked(query_id) lists."""
    nodes = collapsed(vectors, k)
    graph = build_graph(nodes.vectors)
    queries = vectors.join(asked, F.col("vec_id") == F.col("query_id"), "left_semi").select(F.col("vec_id").alias("query_id"), *same_vector(F.col("vec")))
    queries = stored(queries.join(nodes.vectors.select(F.col("vec_id").alias("node"), "t1", "t2"), ["t1", "t2"]).select("query_id", "node"), "queries")
    entered = nodes.vectors.join(queries.select(F.col("node").alias("vec_id")).distinct(), "vec_id", "left_semi")
    found = search(graph, entered.select(F.col("vec_id").alias("query_id"), "vec"), k)
    itself = entered.select(F.col("vec_id").alias("node"), F.col("vec_id").alias("other"), F.lit(0.0).alias("score"))
    near = itself.unionByName(found.select(F.col("query_id").alias("node"), F.col("vec_id").alias("other"), "score"))
    ids = nodes.members.join(nodes.vectors.select(F.col("vec_id").alias("other"), "t1", "t2"), ["t1", "t2"]).select("other", "vec_id")
    enough = F.row_number().over(Window.partitionBy("node").orderBy("score", "vec_id"))
    results = stored(near.join(ids, "other").withColumn("place", enough).filter(F.col("place") <= k + 1).select("node", "vec_id", "score"), "nearest")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    ranked = queries.join(results, "node").filter("vec_id <> query_id").withColumn("rank", rank).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = usable(table(spark, sf_dir, "embeddings"))
    return neighbours(vectors, vectors.filter(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id")))
