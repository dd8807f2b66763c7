"""Removal of repeated byte strings by blockwise suffix sorting with a cover sample.

A byte goes if a string of `length` bytes that covers it also starts anywhere else in the table. Finding
these strings means sorting all suffixes, to a depth of length, and looking at equal neighbours. No task
can sort all suffixes at once, nor compare long equal ones byte by byte, so:

1. Cover sample. Each suffix is represented by one sampled position within its first `length` bytes: the
   place of the smallest hash of a quarter as long a string (gram) there. Equal suffixes sample equal
   places, so any two suffixes can be compared from their samples on; for 400 bytes about one position in
   150 is a sample. (A cover of fixed residues has the same property with one position in 13 to 16, too
   many to shuffle.)
2. Sample ranks. A sample's rank is the hash of its context, the bytes of all suffixes that it stands
   for. Samples with equal ranks tie for all their suffixes: these are repeated, without being compared.
   Equal samples of a batch of documents are one row from the start, so a passage that many documents
   hold sends one row a batch into the shuffles, and ties within a batch need none.
3. Suffix buckets. Samples whose string occurs with several contexts are cut into buckets by a longer
   core, and one bucket at a time has its suffixes sorted, to find those that are equal though their
   contexts differ. A bucket with very many contexts has its suffixes spread over tasks by their hash and
   counted there instead, so no task holds a hot bucket.

Documents are treated as UTF-8 bytes; matches never cross documents. 64-bit hashes stand for strings.

Defined results: null texts count as empty; texts shorter than length bytes keep all their bytes;
repeated rows repeat each other's strings, so all of these go from each. Extra columns are ignored; texts
are read whole, however long, in pieces that overlap by length - 1 bytes. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import broadcast_if_small, give_back, lean_batches, spread_table, stored
from .decontaminate import row_keys
from .near_dedup import mixed

LENGTH = 400
#: Of cut passages in a training corpus: no passage of over 50 words of three letters or more is shorter.
PASSAGE = 200
#: Bytes that a task works on at a time.
PIECE = 1 << 19
#: Contexts in a bucket beyond which its suffixes are spread by their hash.
HOT = 4_096
SMALL = 200_000
KEYS = ["k1", "k2"]
#: Low bits of a sliding key hold the position; PIECE + overlap must fit.
PLACE_BITS = np.uint64(24)


def gram_of(length: int) -> int:
    """Bytes of the strings whose hashes choose the samples."""
    return length // 4


def step_of(length: int) -> int:
    """Suffixes of a context are bucketed by how far they start before the sample, in steps of so many bytes."""
    return max(1, 3 * length // 16)


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, and a random number for each byte."""
    base = 0x2545F4914F6CDD1D
    inverse = pow(base, -1, 1 << 64)
    steps = lambda x: np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, x, np.uint64)]))
    return steps(base), steps(inverse), np.random.default_rng(5).integers(1, 1 << 63, 256, np.uint64)


class Hashes:
    """Hashes of all strings within some bytes."""

    def __init__(self, data: np.ndarray) -> None:
        powers, self.inverse, codes = _powers(max(2 * PIECE + (1 << 13), len(data) + 1))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(codes[data] * powers[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return (self.sums[stop] - self.sums[start]) * self.inverse[start]

    def windows(self, length: int) -> np.ndarray:
        """Hash of the string of so many bytes at each position."""
        n = max(len(self.sums) - length, 0)
        return (self.sums[length : length + n] - self.sums[:n]) * self.inverse[:n]


def sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each `width` consecutive keys."""
    n = len(keys) - width + 1
    padded = np.full(-(-len(keys) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(keys)] = keys
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def samples(data: np.ndarray, ends: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Samples of texts laid end to end: (text, first suffix, last suffix, sample, gram hash, rank)."""
    nothing = tuple(np.zeros(0, np.int64) for _ in range(4)) + tuple(np.zeros(0, np.uint64) for _ in range(2))
    if len(data) < length:
        return nothing
    hashes = Hashes(data)
    grams = mixed(hashes.windows(gram_of(length)))
    places = np.arange(len(grams), dtype=np.uint64)
    least = sliding_least((grams >> PLACE_BITS << PLACE_BITS) | places, length - gram_of(length) + 1)
    sampled = (least & np.uint64((1 << int(PLACE_BITS)) - 1)).astype(np.int64)
    starts = np.concatenate([[0], ends[:-1]])
    text = np.repeat(np.arange(len(ends)), ends - starts)[: len(sampled)]
    inside = np.flatnonzero(np.arange(len(sampled)) + length <= ends[text])
    if not len(inside):
        return nothing
    new = np.ones(len(inside), bool)
    new[1:] = (np.diff(inside) != 1) | (np.diff(sampled[inside]) != 0) | (np.diff(text[inside]) != 0)
    first = inside[new]
    last = inside[np.append(np.flatnonzero(new)[1:], len(inside)) - 1]
    place = sampled[first]
    shape = mixed((place - first).astype(np.uint64) * np.uint64(length) + (last - first).astype(np.uint64))
    rank = mixed(hashes.of(first, last + length) ^ shape)
    return text[first], first, last, place, grams[place], rank


def _pieces(texts: list[bytes], length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Groups of (text, offset, bytes) of about PIECE bytes; long texts are cut with an overlap."""
    group, size = [], 0
    for i, raw in enumerate(texts):
        for at in range(0, max(len(raw) - length + 1, 0), PIECE):
            part = raw[at : at + PIECE + length - 1]
            group.append((i, at, part))
            size += len(part)
            if size >= PIECE:
                yield group
                group, size = [], 0
    if group:
        yield group


def _table(columns: list, kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def _together(columns: list[np.ndarray]) -> list[pa.Array]:
    """Samples (k1, k2, gram, rank, first, lead, width) with equal gram and rank as one row: with their number, and the places (k1, k2, first) of all but the first."""
    k1, k2, gram, rank, first, lead, width = columns
    order = np.lexsort((first, k2, k1, rank, gram))
    k1, k2, gram, rank, first, lead, width = (c[order] for c in (k1, k2, gram, rank, first, lead, width))
    at = np.flatnonzero(np.append(True, (np.diff(gram) != 0) | (np.diff(rank) != 0))) if len(gram) else np.zeros(0, np.int64)
    n = np.diff(np.append(at, len(gram)))
    places = np.column_stack([k1, k2, first]).astype("<i8")
    more = [places[a + 1 : a + m].tobytes() if m > 1 else None for a, m in zip(at.tolist(), n.tolist(), strict=True)]
    kinds = [pa.int64()] * 5 + [pa.int32()] * 2 + [pa.int64(), pa.binary()]
    return [pa.array(c, k) for c, k in zip([*(c[at] for c in (k1, k2, gram, rank, first, lead, width)), n, more], kinds, strict=True)]


def cover(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Samples of docs(k1, k2, text): gram, rank, first (offset of the first suffix), lead, width; n and more of _together."""
    names = ["k1", "k2", "gram", "rank", "first", "lead", "width", "n", "more"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [np.asarray(batch.column(k)) for k in KEYS]
            texts = [x.as_buffer().to_pybytes() for x in batch.column("raw")]
            found = []
            for group in _pieces(texts, length):
                data = np.frombuffer(b"".join(part for _, _, part in group), np.uint8)
                ends = np.cumsum([len(part) for _, _, part in group])
                piece, first, last, place, gram, rank = samples(data, ends, length)
                owner = np.array([i for i, _, _ in group])[piece]
                shift = np.array([at - (end - len(part)) for (_, at, part), end in zip(group, ends, strict=True)])[piece]
                found.append([keys[0][owner], keys[1][owner], gram.astype(np.int64), rank.astype(np.int64), first + shift, place - first, last - first + 1])
            if found:
                yield pa.RecordBatch.from_arrays(_together([np.concatenate(c) for c in zip(*found, strict=True)]), names)
        give_back()

    schema = "k1 long, k2 long, gram long, rank long, first long, lead int, width int, n long, more binary"
    return docs.select(*KEYS, F.encode("text", "utf-8").alias("raw")).mapInArrow(run, schema)


def _runs(k1: np.ndarray, k2: np.ndarray, start: np.ndarray, stop: np.ndarray) -> list[np.ndarray]:
    """The spans (start, stop) of each key, those that overlap or touch as one."""
    order = np.lexsort((start, k2, k1))
    k1, k2, start, stop = (c[order] for c in (k1, k2, start, stop))
    owner = np.cumsum(np.append(False, (np.diff(k1) != 0) | (np.diff(k2) != 0)))
    reach = np.maximum.accumulate((owner << 40) + stop)
    new = np.append(True, (owner[1:] << 40) + start[1:] > reach[:-1])
    at = np.flatnonzero(new)
    return [k1[at], k2[at], start[at], reach[np.append(at[1:], len(start)) - 1] - (owner[at] << 40)]


def spans_of(sampled: DataFrame, length: int) -> DataFrame:
    """(k1, k2, start, stop) of all places of samples whose suffixes are repeated, joined within a batch."""
    names = ["k1", "k2", "start", "stop"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n = np.asarray(batch.column("n"))
            own = np.column_stack([np.asarray(batch.column(c)) for c in ("k1", "k2", "first")])
            more = np.frombuffer(b"".join(batch.column("more").drop_null().to_pylist()), "<i8").reshape(-1, 3)
            places = np.concatenate([own, more])
            reach = np.concatenate([(r := np.asarray(batch.column("width")).astype(np.int64) - 1 + length), np.repeat(r, n - 1)])
            yield _table(_runs(places[:, 0], places[:, 1], places[:, 2], places[:, 2] + reach), [pa.int64()] * 4, names)
        give_back()

    return sampled.select(*KEYS, "first", "width", "n", "more").mapInArrow(run, "k1 long, k2 long, start long, stop long")


def bucket_rows(docs: DataFrame, contexts: DataFrame, length: int) -> DataFrame:
    """Parts of contexts, with their bytes, keyed by the core that all their suffixes have in common.

    A context is cut by how far suffixes start before the sample; suffixes of one part share
    length - step + 1 bytes, the core.
    """
    step = step_of(length)
    listed = contexts.groupBy(*KEYS).agg(F.collect_list(F.struct("first", "lead", "width", "n")).alias("contexts"))
    keys = broadcast_if_small(contexts.select(*KEYS).distinct(), SMALL)
    texts = docs.join(keys, KEYS, "left_semi").dropDuplicates(KEYS).select(*KEYS, F.encode("text", "utf-8").alias("raw"))
    names = ["core", "k1", "k2", "first", "n", "bytes"]
    kinds = [pa.int64()] * 5 + [pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k1, k2, raw, found in zip(*(batch.column(c) for c in ("k1", "k2", "raw", "contexts")), strict=True):
                raw, k1, k2, rows = raw.as_buffer(), k1.as_py(), k2.as_py(), []
                for context in found.as_py():
                    sample = context["first"] + context["lead"]
                    high, low = context["lead"], context["lead"] - context["width"] + 1
                    for part in range(low // step, high // step + 1):
                        far, near = min(high, part * step + step - 1), max(low, part * step)
                        core = raw[sample - part * step : sample - part * step - step + 1 + length]
                        code = hashlib.blake2b(memoryview(core), digest_size=8, salt=part.to_bytes(2, "big")).digest()
                        rows.append((int.from_bytes(code, "big", signed=True), k1, k2, sample - far, context["n"], bytes(memoryview(raw)[sample - far : sample - near + length])))
                yield _table(list(zip(*rows, strict=True)), kinds, names)
        give_back()

    schema = "core long, k1 long, k2 long, first long, n long, bytes binary"
    return texts.join(listed, KEYS).mapInArrow(run, schema)


def _suffixes(parts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(part, offset, hash) of every suffix, to a depth of length, of each part."""
    counts = np.array([len(p) - length + 1 for p in parts])
    starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])[:-1]])
    row = np.repeat(np.arange(len(parts)), counts)
    offset = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = starts[row] + offset
    return row, offset, mixed(Hashes(np.frombuffer(b"".join(parts), np.uint8)).of(at, at + length))


def _batches_of_parts(parts: list[bytes]) -> Iterator[tuple[int, int]]:
    start, size = 0, 0
    for i, part in enumerate(parts):
        size += len(part)
        if size >= PIECE:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(parts):
        yield start, len(parts)


def repeated_in_buckets(rows: DataFrame, length: int) -> DataFrame:
    """(k1, k2, start, stop) of suffixes that lone contexts share with others; sorts a bucket at a time."""
    columns = ["core", "k1", "k2", "first", "n", "bytes"]
    names, kinds = ["k1", "k2", "start", "stop"], [pa.int64()] * 4

    def equal(held: list[tuple]) -> list[tuple]:
        row, offset, code = (np.concatenate(x) for x in zip(*((r + a, o, c) for a, b in _batches_of_parts([h[5] for h in held]) for r, o, c in [_suffixes([h[5] for h in held[a:b]], length)]), strict=True))
        order = np.argsort(code, kind="stable")
        same = code[order][1:] == code[order][:-1]
        twin = np.zeros(len(code), bool)
        twin[order[1:][same]] = twin[order[:-1][same]] = True
        twin &= np.array([h[4] for h in held])[row] == 1
        at = np.flatnonzero(twin)
        runs = np.split(at, np.flatnonzero((np.diff(row[at]) != 0) | (np.diff(offset[at]) != 1)) + 1) if len(at) else []
        spans = ((held[row[r[0]]], int(offset[r[0]]), int(offset[r[-1]])) for r in runs)
        return [(h[1], h[2], h[3] + a, h[3] + b + length) for h, a, b in spans]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        bucket: list[tuple] = []
        size = 0
        for batch in batches:
            found = []
            for row in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                if bucket and row[0] != bucket[-1][0]:
                    held += bucket if len(bucket) > 1 else []
                    bucket = []
                    if size > PIECE:
                        found += equal(held) if held else []
                        held, size = [], 0
                bucket.append(row)
                size += len(row[5])
            if found:
                yield _table(list(zip(*found, strict=True)), kinds, names)
        held += bucket if len(bucket) > 1 else []
        if held and (found := equal(held)):
            yield _table(list(zip(*found, strict=True)), kinds, names)
        held, bucket = [], []
        give_back()

    return rows.select(*columns).repartition("core").sortWithinPartitions("core").mapInArrow(run, "k1 long, k2 long, start long, stop long")


def repeated_in_hot_buckets(rows: DataFrame, length: int) -> DataFrame:
    """The same for buckets of any size: suffixes spread over tasks by their hash and are counted there."""
    names, kinds = ["code", "k1", "k2", "start", "n"], [pa.int64()] * 5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = batch.column("bytes").to_pylist()
            k1, k2, first, n = (np.asarray(batch.column(c)) for c in ("k1", "k2", "first", "n"))
            for a, b in _batches_of_parts(parts):
                row, offset, code = _suffixes(parts[a:b], length)
                row = row + a
                yield _table([code.astype(np.int64), k1[row], k2[row], first[row] + offset, n[row]], kinds, names)

    spread = rows.mapInArrow(run, "code long, k1 long, k2 long, start long, n long")
    often = spread.groupBy("code").agg(F.count("*").alias("times")).filter("times > 1").select("code")
    return spread.filter("n = 1").join(often, "code", "left_semi").select(*KEYS, "start", (F.col("start") + length).alias("stop"))


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(k1, k2, start, stop): byte ranges of docs(k1, k2, text) that are covered by repeated strings of so many bytes.

    What the samples meet is stored first, so that Spark can split frequent grams and ranks on the other side.
    """
    if length < 4:
        raise ValueError("length must be at least 4 bytes")
    lean_batches(docs.sparkSession)
    sampled = stored(cover(docs, length), "cover")
    often = stored(sampled.groupBy("gram").agg(F.sum("n").alias("times")).filter("times > 1").select("gram"), "frequent-grams")
    repeated = stored(sampled.drop("more").join(often, "gram", "left_semi"), "repeated-samples")
    ranks = repeated.groupBy("gram", "rank").agg(F.sum("n").alias("n"), F.min(F.struct("k1", "k2", "first", "lead", "width")).alias("one"))
    ranks = stored(ranks.select("gram", "rank", "n", "one.*"), "ranks")
    together = spans_of(sampled.filter("n > 1"), length)
    ties = repeated.filter("n = 1").join(ranks.filter("n > 1").select("gram", "rank"), ["gram", "rank"], "left_semi")
    apart = ties.select(*KEYS, F.col("first").alias("start"), (F.col("first") + F.col("width") - 1 + length).alias("stop"))
    several = stored(ranks.groupBy("gram").agg(F.count("*").alias("contexts"), F.min("n").alias("fewest")).filter("contexts > 1 AND fewest = 1").select("gram"), "several-contexts")
    contexts = stored(ranks.join(several, "gram", "left_semi"), "contexts")
    rows = stored(bucket_rows(docs, contexts, length), "buckets")
    sizes = stored(rows.groupBy("core").agg(F.count("*").alias("size")).filter("size > 1"), "bucket-sizes")
    hot = broadcast_if_small(sizes.filter(F.col("size") > HOT).select("core"), SMALL)
    shared = broadcast_if_small(sizes.filter(F.col("size") <= HOT).select("core"), SMALL)
    partly = repeated_in_buckets(rows.join(shared, "core", "left_semi"), length)
    hotly = repeated_in_hot_buckets(rows.join(hot, "core", "left_semi"), length)
    return together.unionByName(apart).unionByName(partly).unionByName(hotly)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of overlapping or touching spans."""
    out: list[tuple[int, int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], stop))
        else:
            out.append((start, stop))
    return out


def _kept(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for span in spans for x in span), len(raw)]
    return b"".join(raw[a:b] for a, b in list(pairwise(edges))[::2])


def _at_characters(raw: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """spans drawn in so that they cut no character."""
    out = []
    for start, stop in spans:
        while start < stop and raw[start] & 0xC0 == 0x80:
            start += 1
        while stop > start and stop < len(raw) and raw[stop] & 0xC0 == 0x80:
            stop -= 1
        if start < stop:
            out.append((start, stop))
    return out


def with_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """_row (all columns of docs) and the repeated spans of its text, null where there are none."""
    keyed = docs.select(F.struct("*").alias("_row"), *row_keys(F.col("doc_id"), F.coalesce("text", F.lit(""))), F.coalesce("text", F.lit("")).alias("text"))
    spans = repeated_spans(keyed.select(*KEYS, "text"), length)
    listed = stored(spans.groupBy(*KEYS).agg(F.collect_set(F.struct("start", "stop")).alias("spans")), "spans")
    return keyed.select("_row", *KEYS).join(listed, KEYS, "left").select("_row", "spans")


def removal_report(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of docs(doc_id, text)."""
    found = with_spans(docs.select("doc_id", "text"), length).select("_row.doc_id", F.coalesce(F.encode("_row.text", "utf-8"), F.lit(b"")).alias("raw"), "spans")
    schema = found.select("doc_id").schema.add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept_sha256", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for raw, spans in zip(batch.column("raw"), batch.column("spans"), strict=True):
                raw = raw.as_py()
                runs = merged([(s["start"], s["stop"]) for s in spans.as_py() or []])
                left = _kept(raw, runs)
                rows.append((len(raw), len(raw) - len(left), len(runs), hashlib.sha256(left).hexdigest()))
            kinds = pa.int64(), pa.int64(), pa.int64(), pa.string()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], schema.names)

    return found.mapInArrow(run, schema)


def without_repeats(docs: DataFrame, length: int = PASSAGE) -> DataFrame:
    """docs with the strings of so many bytes that repeat cut out of `text`, but for parts of characters; n_chars follows."""

    def cut(texts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for text, spans in texts:
            out = []
            for one, found in zip(text, spans, strict=True):
                raw = (one.as_py() or "").encode()
                runs = _at_characters(raw, merged([(s["start"], s["stop"]) for s in found.as_py() or []]))
                out.append(_kept(raw, runs).decode() if one.is_valid else None)
            yield pa.array(out, pa.string())

    row = F.col("_row").withField("text", F.when(F.col("spans").isNull(), F.col("_row.text")).otherwise(F.arrow_udf(cut, T.StringType())("_row.text", "spans")))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.length(row["text"]).cast(docs.schema["n_chars"].dataType))
    return with_spans(docs, length).select(row.alias("_row")).select("_row.*")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal_report(spread_table(spark, sf_dir, "documents", "doc_id", "text"))
