"""Near duplicates by ProbMinHash, banding and verification.

Shingles are five consecutive words (of fewer words, all of them). Every shingle of a document is a
Poisson process whose rate is its weight; each arrival falls on one of `REGISTERS` registers, and a
register keeps the shingle that arrives first. A document stops when its next arrivals come later than
all its registers hold. Two registers agree with the probability Jaccard similarity of the two weighted
sets; with equal weights, the default, that is the Jaccard similarity of the sets.

1. Texts that are equal form one copy class; only one member goes on.
2. Registers are cut into bands; documents that agree on a band share a bucket, and every two of them
   are a candidate if the registers suggest that the threshold may be met, in the first band that both
   agree on. Buckets are worked through in blocks of about `BLOCK` documents and of bounded shingles,
   every block with itself and with every other, so large buckets spread over many tasks. Pairs travel
   as bits of the documents' rows.
3. Pairs are verified on the whole sets of shingles, block by block again. What leaves a block are its
   documents' numbers of links, and as few rows as tie its linked documents together.
4. Connected components of these rows are the near-duplicate classes.

Defined results: null texts count as empty; texts without words are only duplicates of equal texts.
Rows with a null doc_id take no part: class null, no links. Rows that share a doc_id count as one
document. An empty table gives no rows; extra columns are ignored; texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import broadcast_if_small, components, give_back, kept, lean_batches, spread_table, stored, words

SHINGLE = 5
THRESHOLD = 0.8
REGISTERS = 80
BANDS = 20
#: Documents and shingles of a block at most, about; cells of a matrix of documents and shingles.
BLOCK = 1_024
BLOCK_SHINGLES = 1 << 20
DENSE = 1 << 22
#: How far registers may underestimate the similarity of a pair that is still verified: over 4 deviations.
SLACK = 0.2
GROUP = 1 << 18
SMALL = 200_000


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of 64-bit numbers (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(word_hashes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different shingles of each row of words: (row, hash, count), sorted by row."""
    word_hashes = word_hashes.astype(np.uint64)
    counts = np.where(lengths > 0, np.maximum(lengths - SHINGLE + 1, 1), 0)
    rows = np.repeat(np.arange(len(lengths)), counts)
    starts = np.repeat(np.cumsum(lengths) - lengths, counts) + np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
    reach = np.minimum(lengths[rows], SHINGLE)
    code = np.zeros(len(rows), np.uint64)
    for i in range(SHINGLE):
        inside = i < reach
        word = word_hashes[np.where(inside, starts + i, 0)] if len(word_hashes) else code
        code = np.where(inside, mixed(code * np.uint64(0x9E3779B97F4A7C15) + word + np.uint64(i + 1)), code)
    order = np.lexsort((code, rows))
    rows, code = rows[order], code[order]
    first = np.ones(len(rows), bool)
    first[1:] = (rows[1:] != rows[:-1]) | (code[1:] != code[:-1])
    at = np.flatnonzero(first)
    return rows[at], code[at], np.diff(np.append(at, len(rows)))


def prob_min_hash(rows: np.ndarray, codes: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    """Registers (n x REGISTERS) of n weighted sets given as (row, element, weight); 0 where a set is empty."""
    held = np.full(n * REGISTERS, np.inf)
    first = np.zeros(n * REGISTERS, np.uint64)
    times = np.zeros(len(codes))
    step = 0
    while len(codes):
        step += 1
        draw = mixed(codes + np.uint64(step * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        times = times - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53) / weights
        place = rows * REGISTERS + (mixed(draw) % np.uint64(REGISTERS)).astype(np.int64)
        better = np.flatnonzero(times < held[place])
        better = better[np.argsort(-times[better], kind="stable")]
        held[place[better]] = times[better]
        first[place[better]] = codes[better]
        alive = times < held.reshape(n, REGISTERS).max(axis=1)[rows]
        rows, codes, weights, times = rows[alive], codes[alive], weights[alive], times[alive]
    return first.reshape(n, REGISTERS)


def bands_of(registers: np.ndarray) -> np.ndarray:
    """A hash of each band of registers."""
    parts = registers.reshape(len(registers), BANDS, REGISTERS // BANDS)
    code = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for i in range(parts.shape[2]):
        code = mixed(code * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, i])
    return code


def _groups(lengths: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about GROUP words each."""
    start, total = 0, 0
    for i, length in enumerate(lengths):
        total += int(length)
        if total >= GROUP:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(lengths):
        yield start, len(lengths)


def word_hashes(docs: DataFrame, *keep: str) -> DataFrame:
    return docs.select(*keep, F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("words"))


def signatures(docs: DataFrame, keep: list[str], weighted: bool = False) -> DataFrame:
    """Columns of `keep`, n_shingles, band hashes and registers (low 32 bits each) of docs(text, *keep)."""
    hashed = word_hashes(docs, *keep)
    schema = hashed.select(*keep).schema.add("n_shingles", "long").add("bands", T.ArrayType(T.LongType())).add("registers", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.asarray(batch.column("words").flatten())
            lengths = np.asarray(batch.column("words").value_lengths()).astype(np.int64)
            ends = np.append(0, np.cumsum(lengths))
            for a, b in _groups(lengths):
                rows, codes, counts = shingles(values[ends[a] : ends[b]], lengths[a:b])
                registers = prob_min_hash(rows, codes, counts.astype(np.float64) if weighted else np.ones(len(codes)), b - a)
                sizes = np.bincount(rows, minlength=b - a)
                listed = [x if n else [] for x, n in zip(bands_of(registers).astype(np.int64), sizes, strict=True)]
                low = registers.astype(np.uint32)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).slice(a, b - a) for k in keep), pa.array(sizes, pa.int64()), pa.array(listed, pa.list_(pa.int64())), pa.array([x.tobytes() for x in low], pa.binary())],
                    schema.names,
                )
        give_back()

    return hashed.mapInArrow(run, schema)


def shingle_sets(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Columns of `keep` and the different shingles of docs(text, *keep)."""
    hashed = word_hashes(docs, *keep)
    schema = hashed.select(*keep).schema.add("shingles", T.ArrayType(T.LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.asarray(batch.column("words").flatten())
            lengths = np.asarray(batch.column("words").value_lengths()).astype(np.int64)
            ends = np.append(0, np.cumsum(lengths))
            for a, b in _groups(lengths):
                rows, codes, _ = shingles(values[ends[a] : ends[b]], lengths[a:b])
                offsets = np.append(0, np.cumsum(np.bincount(rows, minlength=b - a))).astype(np.int32)
                sets = pa.ListArray.from_arrays(pa.array(offsets), pa.array(codes.astype(np.int64)))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(a, b - a) for k in keep), sets], schema.names)
        give_back()

    return hashed.mapInArrow(run, schema)


def block_mates(sizes: np.ndarray, registers: np.ndarray, sides: tuple[np.ndarray, np.ndarray], band: int, threshold: float) -> np.ndarray:
    """Which rows of the first side make a pair worth verifying with which rows of the second (rows x rows).

    A pair counts in the first band that it agrees on only, so it is met once. Where both sides are the
    same rows, the row that comes first has the pair.
    """
    first, second = sides
    depth = REGISTERS // BANDS
    alike = np.zeros((len(first), len(second)), np.uint8)
    earlier, own = np.zeros(alike.shape, bool), np.zeros(alike.shape, bool)
    for at in range(BANDS):
        agree = np.ones(alike.shape, bool)
        for column in registers.T[at * depth : (at + 1) * depth]:
            same = column[first][:, None] == column[second][None, :]
            alike += same
            agree &= same
        if at < band:
            earlier |= agree
        elif at == band:
            own = agree
    large, small = np.maximum.outer(sizes[first], sizes[second]), np.minimum.outer(sizes[first], sizes[second])
    wanted = own & ~earlier & (alike >= (threshold - SLACK) * REGISTERS) & (threshold * large <= small)
    if first is second:
        wanted = np.triu(wanted, 1)
    found = np.zeros((len(sizes), len(sizes)), bool)
    found[np.ix_(first, second)] = wanted
    return found


WORK = ["band", "code", "one", "two"]


def candidate_pairs(classes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """All pairs of classes(class_id, n_shingles, bands, registers) to verify, packed by pairs of blocks.

    Rows (*WORK, class_id, at, mates): a member of a piece of work, its place there, and a bit for the
    place of each member that it is to be verified with. Members without a pair are left out.
    """
    listed = classes.select("class_id", "n_shingles", F.posexplode("bands").alias("band", "code"))
    # Kept before it is joined, so that Spark can split a frequent bucket on the other side.
    buckets = kept(listed.groupBy("band", "code").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("total")).filter("n > 1"))
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("total") / BLOCK_SHINGLES))
    shared = listed.join(buckets, ["band", "code"]).withColumn("blocks", blocks)
    members = shared.withColumn("block", F.pmod(F.xxhash64("class_id", "band"), "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    placed = members.select("band", "code", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "block", "class_id")
    rows = placed.join(classes.select("class_id", "n_shingles", "registers"), "class_id")
    columns = (*WORK, "block", "class_id", "n_shingles", "registers")
    ordered = rows.repartition(*WORK).sortWithinPartitions(*WORK, "class_id").select(*columns)
    schema = rows.select(*WORK, "class_id").schema.add("at", "integer").add("mates", "binary")
    names = schema.names

    def mates(key: tuple, held: list[tuple]) -> Iterator[tuple]:
        band, _, one, two = key
        if len(held) < 2:
            return
        side = np.array([h[0] for h in held])
        first = np.flatnonzero(side == one)
        second = first if one == two else np.flatnonzero(side == two)
        registers = np.frombuffer(b"".join(h[3] for h in held), np.uint32).reshape(len(held), -1)
        found = block_mates(np.array([h[2] for h in held]), registers, (first, second), band, threshold)
        used = np.flatnonzero(found.any(axis=0) | found.any(axis=1))
        for at, (row, bits) in enumerate(zip(used, np.packbits(found[np.ix_(used, used)], axis=1), strict=True)):
            yield (*key, held[row][1], at, bits.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        found: list[tuple] = []
        current, kinds = None, None
        for batch in batches:
            kinds = [*(batch.column(c).type for c in (*WORK, "class_id")), pa.int32(), pa.binary()]
            for *key, block, class_id, size, registers in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                if tuple(key) != current:
                    found += mates(current, held) if held else []
                    held, current = [], tuple(key)
                held.append((block, class_id, size, registers))
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], k) for i, k in enumerate(kinds)], names)
            found = []
        if held:
            found = list(mates(current, held))
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], k) for i, k in enumerate(kinds)], names)
        give_back()

    return ordered.mapInArrow(run, schema)


def common_counts(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """How many values each two of consecutive sets of different values share (sets x sets)."""
    n = len(lengths)
    owner = np.repeat(np.arange(n), lengths)
    _, place, often = np.unique(values, return_inverse=True, return_counts=True)
    several = often[place] > 1
    owner, place = owner[several], (np.cumsum(often > 1) - 1)[place[several]]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    common = np.zeros((n, n))
    width = max(1, DENSE // n)
    edges = np.searchsorted(place, np.arange(0, (place[-1] if len(place) else 0) + width + 1, width))
    for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        if b > a:
            held = np.zeros((n, min(width, place[b - 1] - i * width + 1)), np.float32)
            held[owner[a:b], place[a:b] - i * width] = 1
            common += held @ held.T
    return common


def verified_links(pairs: DataFrame, sets: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b, n) of candidate pairs whose sets(class_id, shingles) have a Jaccard similarity of the threshold or more.

    Where b is null, a has n such links in a piece of work; each link is in one piece. Where n is null,
    a and b are connected by links; these rows tie each piece's classes together, one row fewer than members.
    """
    columns = (*WORK, "class_id", "at", "mates", "shingles")
    ordered = pairs.join(sets, "class_id").repartition(*WORK).sortWithinPartitions(*WORK, "at").select(*columns)
    schema = ordered.select(F.col("class_id").alias("a"), F.col("class_id").alias("b")).schema.add("n", "long")

    def verify(held: list[tuple]) -> Iterator[tuple]:
        n = len(held)
        ids = [h[0] for h in held]
        asked = np.unpackbits(np.frombuffer(b"".join(h[1] for h in held), np.uint8).reshape(n, -1), axis=1, count=n).astype(bool)
        lengths = np.array([len(h[2]) for h in held])
        common = common_counts(np.concatenate([h[2] for h in held]), lengths)
        linked = asked & (common / (np.add.outer(lengths, lengths) - common) >= threshold)
        linked |= linked.T
        degree = linked.sum(axis=1)
        yield from ((ids[i], None, int(degree[i])) for i in np.flatnonzero(degree))
        left = degree > 0
        for root in np.flatnonzero(left):
            if left[root]:
                left[root] = False
                edge = np.array([root])
                while len(edge):
                    edge = np.flatnonzero(linked[edge].any(axis=0) & left)
                    left[edge] = False
                    yield from ((ids[root], ids[i], None) for i in edge)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        current, kinds = None, None
        for batch in batches:
            kinds = [batch.column("class_id").type] * 2 + [pa.int64()]
            found: list[tuple] = []
            values, ends = np.asarray(batch.column("shingles").flatten()), np.append(0, np.cumsum(np.asarray(batch.column("shingles").value_lengths())))
            for row, (*key, class_id, _, bits) in enumerate(zip(*(batch.column(c).to_pylist() for c in columns[:-1]), strict=True)):
                if tuple(key) != current:
                    found += verify(held) if held else []
                    held, current = [], tuple(key)
                held.append((class_id, bits, values[ends[row] : ends[row + 1]].copy()))
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], k) for i, k in enumerate(kinds)], schema.names)
        if held:
            found = list(verify(held))
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], k) for i, k in enumerate(kinds)], schema.names)
        give_back()

    return ordered.mapInArrow(run, schema)


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, weighted: bool = False) -> DataFrame:
    """doc_id, copy_of, class_id, n_links of every row of docs(doc_id, text).

    copy_of: smallest doc_id with the same text. class_id: smallest doc_id of the near-duplicate class.
    n_links: verified links of the copy class.
    """
    lean_batches(docs.sparkSession)
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    known = docs.filter(F.col("doc_id").isNotNull())
    keyed = known.withColumn("t1", F.xxhash64("text")).withColumn("t2", F.xxhash64(F.lit(1), "text"))
    signed = stored(signatures(keyed, ["doc_id", "t1", "t2"], weighted), "signatures")
    copies = kept(signed.groupBy("t1", "t2").agg(F.min("doc_id").alias("class_id")))
    firsts = copies.withColumnRenamed("class_id", "doc_id")
    chosen = signed.join(firsts, ["t1", "t2", "doc_id"], "left_semi")
    classes = stored(chosen.select(F.col("doc_id").alias("class_id"), "n_shingles", "bands", "registers").dropDuplicates(["class_id"]), "classes")
    pairs = stored(candidate_pairs(classes, threshold), "pairs")
    needed = pairs.select("class_id").distinct()
    needed = needed.join(copies, "class_id").withColumnRenamed("class_id", "doc_id")
    texts = keyed.join(broadcast_if_small(needed, SMALL), ["t1", "t2", "doc_id"], "left_semi")
    sets = kept(shingle_sets(texts.select(F.col("doc_id").alias("class_id"), "text"), ["class_id"]).dropDuplicates(["class_id"]))
    links = stored(verified_links(pairs, sets, threshold), "links")
    groups = components(links.filter(F.col("b").isNotNull()).select("a", "b"))
    degree = links.filter(F.col("b").isNull()).groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n_links"))
    marked = copies.join(groups.join(degree, "node"), F.col("class_id") == F.col("node"), "left").select(
        "t1", "t2", F.col("class_id").alias("copy_of"), F.coalesce("component", "class_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")
    )
    found = signed.select("doc_id", "t1", "t2").join(marked, ["t1", "t2"]).select("doc_id", "copy_of", "class_id", "n_links")
    nobody = docs.filter(F.col("doc_id").isNull()).select("doc_id", F.col("doc_id").alias("copy_of"), F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return found.unionByName(nobody)


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with one row of each near-duplicate class, that of the smallest doc_id; columns unchanged.

    Rows with a null doc_id all stay.
    """
    found = stored(near_duplicates(docs, threshold), "near-duplicates")
    gone = broadcast_if_small(found.filter("doc_id <> class_id").select("doc_id").distinct(), SMALL)
    stay = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    twice = found.filter("doc_id = class_id").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    if twice.isEmpty():
        return stay
    twice = broadcast_if_small(twice, SMALL)
    single = docs.join(twice, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id"])
    return stay.join(twice, "doc_id", "left_anti").select(*docs.columns).unionByName(single)


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spread_table(spark, sf_dir, "documents", "doc_id", "text"))
