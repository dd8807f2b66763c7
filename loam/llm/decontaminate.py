r"""Benchmark decontamination on a positional inverted index. DataFrame functions only.

The index holds a posting (term, document, position) for every place of a benchmark term in the training
texts, and one header row a document. It is written once and read several times:

1. term frequencies are counted from the postings;
2. each window (10 consecutive item words; a shorter item is one window) looks up its rarest term; a
   posting at p for a term at offset o of an item puts the item at p - o in that document (its diagonal);
3. the postings of the window's second rarest term are intersected with these, offset-adjusted;
4. on the diagonals left, the postings of all item words are intersected, and runs of matching
   offsets as long as a window are exact phrase matches.

Windows with a term that no document has are dropped at once. `proximity_matches` finds two terms at
most so many words apart in the same way.

Defined results: null or empty texts have no words (n_words 0, not contaminated). Items that are null or
have no words match nothing; what an item without an item_id hits counts as hit, but names no item. Repeated items count once; repeated documents get
a result each. With an empty benchmark nothing is contaminated; without documents there are
no rows. Texts are read whole, however long. Extra columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, kept, spread_table, stored, table, words

WINDOW = 10
#: Rows up to which a stored, benchmark-sized or match-sized table is broadcast; larger ones are shuffled.
SMALL = 200_000
ROW = ["k1", "k2"]
HEADER = ""


class Index(NamedTuple):
    postings: DataFrame  # term_id, k1, k2, pos
    headers: DataFrame  # doc_id, k1, k2, n_words
    item_words: DataFrame  # item, item_id, n, off, term_id


def row_keys(doc_id: Column, text: Column) -> list[Column]:
    """128 bits that tell rows apart by doc_id and text."""
    return [F.xxhash64(doc_id, text).alias("k1"), F.xxhash64(F.lit(1), text, doc_id).alias("k2")]


def item_word_rows(benchmark: DataFrame) -> DataFrame:
    """(item, item_id, n, off, term, term_id): the words of each different item."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("ws")).distinct()
    keyed = items.select(F.xxhash64("item_id", "ws").alias("item"), "item_id", F.size("ws").alias("n"), F.posexplode("ws").alias("off", "term"))
    return keyed.withColumn("term_id", F.xxhash64("term"))


def build_index(docs: DataFrame, item_words: DataFrame) -> Index:
    """Store the postings of all benchmark terms in docs(doc_id, text), and a header a document."""
    item_words = kept(item_words)
    header = docs.sparkSession.range(1).select(F.lit(HEADER).alias("term"), F.lit(0).cast("long").alias("term_id"))
    vocabulary = item_words.select("term", "term_id").distinct().unionByName(header)
    split = docs.select("doc_id", *row_keys(F.col("doc_id"), F.col("text")), words(F.col("text")).alias("ws"))
    listed = split.select("doc_id", "k1", "k2", F.size("ws").alias("n_words"), F.posexplode(F.concat(F.array(F.lit(HEADER)), F.col("ws"))).alias("at", "term"))
    is_header = F.col("term") == HEADER
    index = listed.join(broadcast_if_small(vocabulary, 4 * SMALL), "term").select(
        F.when(~is_header, F.col("term_id")).alias("term_id"), "k1", "k2",
        F.when(is_header, F.col("n_words")).otherwise(F.col("at") - 1).alias("pos"), F.when(is_header, F.col("doc_id")).alias("doc_id"),
    )
    index = stored(index, "postings")
    headers = index.filter(F.col("term_id").isNull()).select("doc_id", "k1", "k2", F.col("pos").cast("long").alias("n_words"))
    return Index(index.filter(F.col("term_id").isNotNull()).select("term_id", "k1", "k2", "pos"), headers, item_words.drop("term"))


def anchors(index: Index, window: int) -> DataFrame:
    """(item, o1, t1, o2, t2): offsets and terms of the two rarest terms of every window that may occur."""
    frequency = index.postings.groupBy("term_id").agg(F.count("*").alias("f"))
    known = index.item_words.join(frequency, "term_id", "left")
    items = known.groupBy("item", "n").agg(F.sort_array(F.collect_list(F.struct("off", "f", "term_id"))).alias("ws"))
    length = F.least(F.lit(window), F.col("n"))
    windows = items.select("item", F.explode(F.transform(F.sequence(F.lit(1), F.col("n") - length + 1), lambda s: F.slice("ws", s, length))).alias("w"))
    possible = windows.filter(F.forall("w", lambda x: x["f"].isNotNull()))
    rarest = possible.select("item", F.array_sort(F.transform("w", lambda x: F.struct(x["f"], x["off"], x["term_id"]))).alias("w"))
    first, second = F.get("w", F.lit(0)), F.get("w", F.lit(1))
    return rarest.select("item", first["off"].alias("o1"), first["term_id"].alias("t1"), second["off"].alias("o2"), second["term_id"].alias("t2")).distinct()


def phrase_matches(index: Index, window: int = WINDOW) -> DataFrame:
    """(k1, k2, item, start, stop): stretches of a document that are made of an item's windows."""
    near = kept(anchors(index, window))
    first = index.postings.join(broadcast_if_small(near, SMALL), F.col("term_id") == F.col("t1"))
    placed = first.select("k1", "k2", "item", (F.col("pos") - F.col("o1")).alias("diagonal"), "o2", "t2")
    lone = placed.filter(F.col("t2").isNull()).select("k1", "k2", "item", "diagonal")
    wanted = placed.filter(F.col("t2").isNotNull()).select(
        "k1", "k2", "item", "diagonal", (F.col("diagonal") + F.col("o2")).alias("pos"), F.col("t2").alias("term_id")
    )
    second_terms = broadcast_if_small(near.select(F.col("t2").alias("term_id")).distinct(), SMALL)
    second = index.postings.join(second_terms, "term_id", "left_semi")
    both = second.join(wanted, ["k1", "k2", "pos", "term_id"]).select("k1", "k2", "item", "diagonal")
    places = stored(both.unionByName(lone).distinct(), "places")

    spread = places.join(broadcast_if_small(index.item_words, SMALL), "item")
    expected = spread.select("k1", "k2", "item", "diagonal", "n", "off", (F.col("diagonal") + F.col("off")).alias("pos"), "term_id").filter("pos >= 0")
    rows = broadcast_if_small(places.select(*ROW).distinct(), SMALL)
    there = index.postings.join(rows, ROW, "left_semi")
    matched = there.join(expected, ["k1", "k2", "pos", "term_id"])
    line = Window.partitionBy("k1", "k2", "item", "diagonal").orderBy("off")
    runs = matched.withColumn("run", F.col("off") - F.dense_rank().over(line))
    spans = runs.groupBy("k1", "k2", "item", "diagonal", "n", "run").agg(F.min("off").alias("a"), F.max("off").alias("b"))
    long_enough = spans.filter(F.col("b") - F.col("a") + 1 >= F.least(F.lit(window), F.col("n")))
    return long_enough.select("k1", "k2", "item", (F.col("diagonal") + F.col("a")).alias("start"), (F.col("diagonal") + F.col("b") + 1).alias("stop"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, k1, k2, n_words, n_hit, item_ids (sorted) of every row of docs(doc_id, text)."""
    index = build_index(docs, item_word_rows(benchmark))
    matches = stored(phrase_matches(index, window), "matches")
    by_start = Window.partitionBy(*ROW).orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.lit(0), F.col("stop") - F.greatest("start", F.coalesce(F.max("stop").over(by_start), F.lit(0))))
    hit = matches.withColumn("fresh", fresh).groupBy(*ROW).agg(F.sum("fresh").alias("n_hit"))
    names = index.item_words.select("item", "item_id").distinct()
    items = matches.select("k1", "k2", "item").distinct().join(broadcast_if_small(names, SMALL), "item")
    listed = items.groupBy(*ROW).agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"))
    return index.headers.join(hit.join(listed, ROW), ROW, "left").select(
        "doc_id", "k1", "k2", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
    )


def proximity_matches(postings: DataFrame, pairs: DataFrame, max_gap: int) -> DataFrame:
    """(pair_id, k1, k2, pos_a, pos_b): places of pairs(pair_id, term_a, term_b) at most max_gap words apart.

    A band join: positions meet by document and by blocks of max_gap + 1 positions, each block with its
    neighbours, so hot documents spread over their blocks.
    """
    block = max_gap + 1
    side = lambda c: postings.join(pairs.select("pair_id", F.xxhash64(c).alias("term_id")), "term_id")
    a = side("term_a").select("pair_id", *ROW, F.col("pos").alias("pos_a"), F.floor(F.col("pos") / block).alias("block"))
    b = side("term_b").select("pair_id", *ROW, F.col("pos").alias("pos_b"), F.explode(F.sequence(F.floor(F.col("pos") / block) - 1, F.floor(F.col("pos") / block) + 1)).alias("block"))
    return a.join(b, ["pair_id", *ROW, "block"]).filter((F.abs(F.col("pos_a") - F.col("pos_b")) <= max_gap) & (F.col("pos_a") != F.col("pos_b"))).drop("block")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs without the rows in which a window of an item occurs; columns unchanged."""
    found = contamination(docs.select("doc_id", "text"), benchmark, window)
    hits = kept(found.filter("n_hit > 0").select("k1", "k2").distinct())
    k1, k2 = row_keys(docs["doc_id"], docs["text"])
    rows = docs.select(F.struct("*").alias("_row"), k1.alias("k1"), k2.alias("k2"))
    return rows.join(broadcast_if_small(hits, SMALL), ["k1", "k2"], "left_anti").select("_row.*")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread_table(spark, sf_dir, "documents", "doc_id", "text")
    found = contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x : x <> '') AS ws FROM documents
), b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x : x <> '') AS ws FROM benchmark
), bs AS (SELECT item_id, ws, least(10, len(ws)) AS l, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS s FROM b WHERE len(ws) > 0),
bw AS (SELECT DISTINCT item_id, l, array_to_string(ws[s:s + l - 1], ' ') AS win FROM bs),
ds AS (SELECT doc_id, ws, l, unnest(range(1, len(ws) - l + 2)) AS s FROM d, (SELECT DISTINCT l FROM bw) WHERE len(ws) >= l),
hits AS (SELECT doc_id, item_id, s, l FROM (SELECT doc_id, l, s, array_to_string(ws[s:s + l - 1], ' ') AS win FROM ds) JOIN bw USING (l, win)),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + l)) AS p FROM hits) GROUP BY doc_id),
i AS (SELECT doc_id, count(item_id) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN i USING (doc_id)
"""
