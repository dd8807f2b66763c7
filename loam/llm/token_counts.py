"""Token counts that follow edits.

The tokens of a text are counted by pre-tokens (the vocabulary's pattern); a pre-token's count never
depends on its neighbours. Each document keeps a tree over its pre-tokens: leaves hold their lengths and
counts, inner nodes the sums of characters and tokens below. An edit finds its place by the sums, keeps
every pre-token that cannot see the edit, re-encodes from a little before it until the new boundaries
fall on old ones again, and renews the sums on the path to the root only.

Trees are kept: `grow` makes a table of them, leaves as arrays, and `apply_edits` makes the next such table
from it and from edits, without encoding what the edits don't touch.

Edits are (start, length, replacement) in code points, applied in turn to the text as it then is; a start
or length beyond the text is cut to it. Defined results: a null text counts as empty (0 tokens); null
edits are none; null fields of an edit are 0, 0 and ''. Repeated rows are counted one by one; extra
columns are ignored; texts are counted whole. Without documents there are no rows.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chat_format import PATTERN, VOCAB, encoding
from .common import give_back, lean_batches, spread_table, stored

LEAF = 256
FAN_OUT = 32
#: A pre-token's match looks at most this far beyond its end: contractions try three characters.
SIGHT = 4
#: Pre-token counts remembered by a task; forgotten all at once beyond that.
REMEMBERED = 100_000


class Counter:
    """Tokens of a pre-token, remembered."""

    def __init__(self, vocab: str) -> None:
        self.encoding, self.pattern, self.known = encoding(vocab), regex.compile(PATTERN), {}

    def counts(self, pieces: list[str]) -> list[int]:
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        for piece in set(pieces).difference(known):
            known[piece] = len(self.encoding.encode_ordinary(piece))
        return [known[piece] for piece in pieces]


class Node:
    """Part of a text: the sums below, and either children or the pre-tokens themselves."""

    __slots__ = ("chars", "tokens", "children", "lengths", "counts")

    def __init__(self, children: list[Node] | None = None, lengths: list[int] = (), counts: list[int] = ()) -> None:
        self.children, self.lengths, self.counts = children, lengths, counts
        self.renew()

    def renew(self) -> None:
        if self.children is None:
            self.chars, self.tokens = sum(self.lengths), sum(self.counts)
        else:
            self.chars, self.tokens = sum(c.chars for c in self.children), sum(c.tokens for c in self.children)


def _leaves(lengths: list[int], counts: list[int]) -> list[Node]:
    return [Node(None, lengths[i : i + LEAF], counts[i : i + LEAF]) for i in range(0, len(lengths), LEAF)]


def _grouped(nodes: list[Node]) -> list[Node]:
    return [Node(nodes[i : i + FAN_OUT]) for i in range(0, len(nodes), FAN_OUT)]


class CountTree:
    """Token count of one text under edits."""

    def __init__(self, text: str, lengths: list[int], counts: list[int], counter: Counter) -> None:
        """From the lengths and counts of the text's pre-tokens."""
        self.text, self.counter, self.reencoded = text, counter, 0
        nodes = _leaves(lengths, counts) or [Node(None, [], [])]
        while len(nodes) > 1:
            nodes = _grouped(nodes)
        self.root = nodes[0]

    @classmethod
    def of(cls, text: str, counter: Counter) -> CountTree:
        """By encoding the whole text."""
        pieces = counter.pattern.findall(text)
        return cls(text, [len(p) for p in pieces], counter.counts(pieces), counter)

    def leaves(self) -> tuple[list[int], list[int]]:
        """Lengths and counts of all pre-tokens."""
        nodes, lengths, counts = [self.root], [], []
        while nodes:
            node = nodes.pop()
            if node.children is None:
                lengths += node.lengths
                counts += node.counts
            else:
                nodes += reversed(node.children)
        return lengths, counts

    @property
    def tokens(self) -> int:
        return self.root.tokens

    def edit(self, start: int, length: int, replacement: str) -> None:
        start = min(max(start, 0), len(self.text))
        stop = min(start + max(length, 0), len(self.text))
        begin = self._boundary(max(start - SIGHT, 0))
        shift = len(replacement) - (stop - start)
        self.text = text = self.text[:start] + replacement + self.text[stop:]
        # New pre-tokens until a boundary at or after the edit is an old boundary too.
        settled = start + len(replacement)
        pieces, at, old = [], begin, self._boundaries(stop)
        old_at = next(old, None)
        while at < len(text):
            if at >= settled:
                while old_at is not None and old_at + shift < at:
                    old_at = next(old, None)
                if old_at is not None and old_at + shift == at:
                    break
            match = self.counter.pattern.match(text, at)
            pieces.append(match[0])
            at = match.end()
        end = at - shift if at < len(text) else self.root.chars
        self.reencoded += len(pieces)
        fresh = self._splice(self.root, begin, end, [len(p) for p in pieces], self.counter.counts(pieces))
        while len(fresh) > 1:
            fresh = _grouped(fresh)
        self.root = fresh[0] if fresh else Node(None, [], [])

    def _boundary(self, char: int) -> int:
        """The last pre-token boundary at or before char."""
        node, base = self.root, 0
        while node.children is not None:
            for child in node.children:
                if char < base + child.chars or child is node.children[-1]:
                    node = child
                    break
                base += child.chars
        ends = np.cumsum([0, *node.lengths]).tolist()
        return base + ends[max(bisect_right(ends, char - base) - 1, 0)]

    def _boundaries(self, char: int) -> Iterator[int]:
        """Old pre-token boundaries from char on; read before the tree changes under them."""

        def walk(node: Node, base: int) -> Iterator[int]:
            if base + node.chars < char:
                return
            if node.children is not None:
                for child in node.children:
                    yield from walk(child, base)
                    base += child.chars
            else:
                for length in node.lengths:
                    if base >= char:
                        yield base
                    base += length

        yield from walk(self.root, 0)

    def _splice(self, node: Node, begin: int, end: int, lengths: list[int], counts: list[int]) -> list[Node]:
        """What takes node's place when [begin, end) of its characters gives way to new pre-tokens."""
        if node.children is None:
            ends = np.cumsum([0, *node.lengths]).tolist()
            first, last = ends.index(begin), len(ends) - 1 - ends[::-1].index(end)
            new_lengths = [*node.lengths[:first], *lengths, *node.lengths[last:]]
            new_counts = [*node.counts[:first], *counts, *node.counts[last:]]
            if len(new_lengths) > 2 * LEAF:
                return _leaves(new_lengths, new_counts)
            node.lengths, node.counts = new_lengths, new_counts
            node.renew()
            return [node] if new_lengths else []
        sizes = [child.chars for child in node.children]
        children, base, given = [], 0, False
        for i, (child, size) in enumerate(zip(node.children, sizes, strict=True)):
            low, high = min(max(begin - base, 0), size), min(end - base, size)
            if not given and (begin - base < size or i == len(sizes) - 1):
                children += self._splice(child, low, max(low, high), lengths, counts)
                given = True
            elif low < high:
                children += self._splice(child, low, high, [], [])
            else:
                children.append(child)
            base += size
        if not children or len(children) > 2 * FAN_OUT:
            return _grouped(children)
        node.children = children
        node.renew()
        return [node]


def attach_edits(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """docs with a column `edits` from edits(doc_id, seq, start, length, replacement), in the order of seq."""
    listed = edits.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("seq", "start", "length", "replacement"))).alias("edits"))
    listed = listed.withColumn("edits", F.transform("edits", lambda e: F.struct(e["start"], e["length"], e["replacement"])))
    return docs.join(listed, "doc_id", "left")


TREE = "text string, lengths array<int>, counts array<int>, n_tokens long"


def grow(docs: DataFrame, vocab: str = VOCAB) -> DataFrame:
    """doc_id, text, lengths and counts (the tree's leaves), n_tokens of docs(doc_id, text)."""
    schema = T.StructType([*docs.select("doc_id").schema, *T.StructType.fromDDL(TREE)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(vocab)
        for batch in batches:
            leaves = [(p, counter.counts(p)) for p in map(counter.pattern.findall, batch.column("text").to_pylist())]
            lengths, counts = ([[len(x) for x in p] for p, _ in leaves], [c for _, c in leaves])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), *(pa.array(x, pa.list_(pa.int32())) for x in (lengths, counts)), pa.array(map(sum, counts), pa.int64())], schema.names)

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, schema)


def apply_edits(trees: DataFrame, vocab: str = VOCAB) -> DataFrame:
    """The trees(doc_id, text, lengths, counts, n_tokens, edits array<struct<start, length, replacement>>) after their edits.

    Also n_tokens_before, and n_reencoded: pre-tokens that the edits made necessary to encode again.
    """
    columns = ["doc_id", "text", "lengths", "counts", "edits"]
    schema = T.StructType([*trees.select("doc_id").schema, *T.StructType.fromDDL(TREE)]).add("n_tokens_before", "long").add("n_reencoded", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(vocab)
        for batch in batches:
            rows = []
            for text, lengths, counts, edits in zip(*(batch.column(c) for c in columns[1:]), strict=True):
                tree = CountTree(text.as_py(), lengths.as_py(), counts.as_py(), counter)
                before = tree.tokens
                for edit in edits.as_py() or []:
                    edit = edit or {}
                    tree.edit(edit.get("start") or 0, edit.get("length") or 0, edit.get("replacement") or "")
                rows.append((tree.text, *tree.leaves(), tree.tokens, before, tree.reencoded))
            kinds = pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.int64()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], schema.names)
        give_back()

    lean_batches(trees.sparkSession)
    return trees.select(*columns).mapInArrow(run, schema)


def edit_counts(docs: DataFrame, vocab: str = VOCAB) -> DataFrame:
    """docs(doc_id, text, edits) with its token counts: n_tokens, n_tokens_after the edits, n_chars_after, and n_reencoded.

    The trees are stored before they are edited; the edits travel with their documents.
    """
    docs = docs.select(F.struct("doc_id", "edits").alias("doc_id"), "text")
    trees = stored(grow(docs, vocab), "count-trees")
    after = apply_edits(trees.select("doc_id.doc_id", "text", "lengths", "counts", "doc_id.edits"), vocab)
    return after.select("doc_id", F.col("n_tokens_before").alias("n_tokens"), F.col("n_tokens").alias("n_tokens_after"), F.length("text").cast("long").alias("n_chars_after"), "n_reencoded")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every document, and again after three edits: in its middle, at its quarter, at its end."""
    docs = spread_table(spark, sf_dir, "documents", "doc_id", "text")
    size = F.coalesce(F.length("text"), F.lit(0)).cast("long")
    edit = lambda start, length, text: F.struct(start.cast("long").alias("start"), F.lit(length).cast("long").alias("length"), F.lit(text).alias("replacement"))
    edits = F.array(edit(F.floor(size / 2), 5, " edited  words"), edit(F.floor(size / 4), 7, ""), edit(size, 0, "\n The end."))
    return edit_counts(docs.withColumn("edits", edits))
