"""Training-data operators against brute force, exact round trips, held-out accuracy and odd inputs."""

from __future__ import annotations

import hashlib
import random
import re
import struct
import zlib
from pathlib import Path

import numpy as np
import pytest
import regex
import sentencepiece
import xxhash
import zstandard
from pyspark.sql import functions as F

from loam.llm import chat_format, decontaminate, language_id, license_scan, near_dedup, neighbours, quality, sentencepiece_codec, suffix_dedup, token_counts
from loam.llm.common import components
from loam.llm.license_texts import KNOWN
from loam.llm.queries import QUERIES, SQL
from tests.oracle import assert_same, connect

SF_DIR = "/root/testdata/sf0.001"
ODD_TEXTS = [None, "", " ", "\x00", "a", "é" * 500, "word " * 40_000, "same text", "same text"]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, null ids, and extra columns that clash with ours."""
    rows = [(i if i % 4 else None, t, "en" if i % 2 else None, -1.0, 7, "x") for i, t in enumerate(ODD_TEXTS)] * 2
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, k1 int, spans string")


def documents(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", low) if w]


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    assert_same(QUERIES[name](spark, SF_DIR), connect(SF_DIR), SQL[name])


# 1 decontamination


def brute_contamination(texts, items):
    found = []
    for text in texts:
        ws, hit, which = words(text), set(), set()
        for item_id, item in items:
            iw = words(item)
            n = min(10, len(iw))
            windows = {tuple(iw[s : s + n]) for s in range(len(iw) - n + 1)} if n else set()
            for s in range(len(ws) - n + 1):
                if tuple(ws[s : s + n]) in windows:
                    hit.update(range(s, s + n))
                    which |= {str(item_id)} if item_id is not None else set()
        found.append((len(ws), len(hit), sorted(which)))
    return found


def test_contamination_against_brute_force(spark):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(25)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 3, 9, 10, 11, 25])))) for i in range(12)] + [(3, "w1 w2"), (None, "w1 w2 w3"), (99, None)]
    texts = [" ".join(rng.choices(vocabulary, k=40)) for _ in range(20)] + [f"W1! {items[6][1].upper()}, {items[6][1]}", "", None, items[4][1], items[4][1]]
    docs = documents(spark, texts)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["item_ids"]) for r in decontaminate.contamination(docs, bench).collect()}
    wanted = brute_contamination(texts, items)
    assert [got[i] for i in range(len(texts))] == wanted
    kept = {r["doc_id"] for r in decontaminate.drop_contaminated(docs, bench).collect()}
    assert kept == {i for i, w in enumerate(wanted) if not w[1]}


def test_contamination_of_odd_inputs(spark, odd):
    bench = spark.createDataFrame([(1, "same text"), (2, "word word word")], "item_id long, text string")
    assert decontaminate.drop_contaminated(odd, bench).columns == odd.columns
    assert decontaminate.contamination(odd, bench).count() == odd.count()
    assert decontaminate.contamination(odd, bench.limit(0)).filter("n_hit > 0").count() == 0
    assert decontaminate.contamination(odd.limit(0), bench).count() == 0


def test_proximity(spark):
    index = decontaminate.build_index(documents(spark, ["a x x b", "a x x x x b", "b a"]), decontaminate.item_word_rows(spark.createDataFrame([(1, "a b")], "item_id long, text string")))
    pairs = spark.createDataFrame([(0, "a", "b")], "pair_id long, term_a string, term_b string")
    found = decontaminate.proximity_matches(index.postings, pairs, 3).join(index.headers, ["k1", "k2"])
    assert sorted((r["doc_id"], r["pos_a"], r["pos_b"]) for r in found.collect()) == [(0, 0, 3), (2, 1, 0)]


# 2 quality


def test_quality_on_held_out_documents(spark):
    scored = QUERIES["op2_quality"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").filter("held_out").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in scored]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in scored)


def plain_features(texts):
    """Word vectors over all texts and the features of each, a token at a time."""
    places, signs = quality.index_vectors()
    index = np.zeros((quality.BUCKETS, quality.DIM))
    for b in range(quality.BUCKETS):
        index[b, places[b]] = signs[b]
    found = [[xxhash.xxh64(t.encode(), seed=42).intdigest() % quality.BUCKETS for t in regex.findall(r"\p{L}+|\p{N}+|[^\p{L}\p{N} \t\n\x0b\f\r]+", text or "")] for text in texts]
    sums = np.zeros_like(index)
    for ids in found:
        for i, word in enumerate(ids):
            for j in range(max(0, i - quality.REACH), min(len(ids), i + quality.REACH + 1)):
                if i != j:
                    sums[word] += index[ids[j]]
    lengths = np.linalg.norm(sums, axis=1, keepdims=True)
    both = np.hstack([sums / np.where(lengths > 0, lengths, 1), index / np.sqrt(quality.NONZERO)])
    repeats = lambda ids, lag: sum(a == b for a, b in zip(ids, ids[lag:], strict=False)) / max(len(ids), 1)
    return np.array([[*(both[ids].mean(axis=0) if ids else np.zeros(2 * quality.DIM)), repeats(ids, 1), repeats(ids, 2)] for ids in found])


def test_quality_features_and_scores_against_a_plain_version(spark):
    rng = random.Random(2)
    good, bad = [f"word{i}" for i in range(60)], ["buy", "now", "!!!", "$$$", "free"]
    texts = [" ".join(rng.choices(good, k=rng.randint(5, 80))) if i % 2 else " ".join(rng.choices(bad, k=rng.randint(5, 80))) for i in range(80)] + ["", None, "a a a b b", "é 12 ,;"]
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    vectors, net = quality.train(docs, labels)
    x = plain_features(texts)
    got = {r["doc_id"]: np.frombuffer(bytes(r["features"]), np.float32) for r in quality.features(docs, ["doc_id"], vectors).collect()}
    assert np.abs(np.array([got[i] for i in range(len(texts))]) - x).max() < 1e-4
    fitted = quality.fit(x[:60], np.array([i % 2 for i in range(60)], float))
    scores = {r["doc_id"]: r["score"] for r in quality.score(docs, ["doc_id"], vectors, net).collect()}
    assert np.abs(np.array([scores[i] for i in range(len(texts))]) - fitted.scores(x)).max() < 0.01
    kept = sorted(r["doc_id"] for r in quality.drop_rejected(docs, labels).collect())
    assert kept == [i for i in range(len(texts)) if scores[i] >= 0.5] and {i for i in range(80) if i % 2} <= set(kept) and not {i for i in range(80) if not i % 2} & set(kept)


def test_quality_of_odd_inputs(spark, odd):
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (3, None), (5, 0), (6, 1)], "doc_id long, quality int")
    assert quality.drop_rejected(odd, labels).columns == odd.columns
    vectors, net = quality.train(odd, labels.limit(0))
    assert net.constant == 0.5
    assert {r["score"] for r in quality.score(odd, ["doc_id"], vectors, net).collect()} == {0.5}
    assert quality.score(odd.limit(0), ["doc_id"], vectors, net).count() == 0


def test_context_sums_do_not_cross_rows():
    places, signs = quality.index_vectors()
    sums = np.zeros(quality.BUCKETS * quality.DIM)
    quality.context_sums(np.array([1, 2, 3]), np.array([0, 0, 1]), 0, places, signs, sums)
    table = sums.reshape(quality.BUCKETS, quality.DIM)
    assert not table[3].any()
    wanted = np.zeros(quality.DIM)
    wanted[places[2]] = signs[2]
    assert (table[1] == wanted).all()


# 3 chat


def test_chat_escapes_are_reversible_and_safe():
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choices("<|\\\nim_start>", k=rng.randrange(30)))
        assert chat_format.unescape(chat_format.escape(text)) == text
        assert "<|" not in chat_format.escape(text)
        assert chat_format.unescape_role(chat_format.escape_role(text)) == text
        assert "\n" not in chat_format.escape_role(text)


def test_chat_of_odd_inputs(spark):
    rows = [(1, None, None, None), (1, 2, "assistant", "x<|im_end|>"), (1, 2, "assistant", "x<|im_end|>"), (None, 0, "a\nb", "y"), (2, 0, "assistant", ""), (2, 1, "user", "long " * 50_000)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("input_ids", F.lit(1))
    found = {r["conv_id"]: r for r in chat_format.read_back(chat_format.format_conversations(turns)).collect()}
    assert found[1]["n_turns"] == 3 and found[1]["loss_chars"] == 2 * len("x<|im_end|>")
    said = "\n\nassistant\nx<|im_end|>\nassistant\nx<|im_end|>\n"
    assert found[1]["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    assert found[None]["turns_sha256"] == hashlib.sha256(b"a\nb\ny\n").hexdigest()
    assert found[2]["loss_chars"] == 0 and found[2]["loss_sha256"] == hashlib.sha256(b"").hexdigest()
    assert chat_format.read_back(chat_format.format_conversations(turns.limit(0))).count() == 0


# 4 token counts


def test_edited_counts_equal_full_counts():
    counter = token_counts.Counter(token_counts.VOCAB)
    rng = random.Random(4)
    parts = ["word", " ", "  ", "\n", "'ll", "é", "123", "!?", "\t \n ", "日本", "a" * 40]
    for _ in range(60):
        tree = token_counts.CountTree.of("".join(rng.choices(parts, k=rng.choice([0, 1, 30, 2000]))), counter)
        for _ in range(5):
            tree.edit(rng.randrange(len(tree.text) + 2), rng.choice([0, 1, 7, 900]), "".join(rng.choices(parts, k=rng.choice([0, 1, 5, 1500]))))
            assert tree.tokens == len(counter.encoding.encode_ordinary(tree.text))
            assert tree.root.chars == len(tree.text)


def test_small_edits_reencode_little():
    tree = token_counts.CountTree.of("some words and more " * 5_000, token_counts.Counter(token_counts.VOCAB))
    tree.edit(50_000, 3, "x")
    assert tree.reencoded < 20


def test_saved_trees_take_a_second_batch_of_edits(spark):
    rng = random.Random(5)
    texts = [" ".join(f"word{rng.randrange(900)}" for _ in range(n)) for n in (0, 3, 4_000, 20_000)]
    trees = token_counts.stored(token_counts.grow(documents(spark, texts)), "trees")
    full = token_counts.Counter(token_counts.VOCAB).encoding.encode_ordinary
    for batch in range(2):
        edits = [(i, seq, rng.randrange(len(t) + 1), rng.choice([0, 9, 40]), f" new words {batch} ") for i, t in enumerate(texts) for seq in range(2)]
        listed = spark.createDataFrame(edits, "doc_id long, seq int, start long, length long, replacement string")
        trees = token_counts.stored(token_counts.apply_edits(token_counts.attach_edits(trees, listed)).drop("n_tokens_before"), "trees")
        for i, _, start, length, new in edits:
            texts[i] = texts[i][:start] + new + texts[i][start + length :]
        rows = {r["doc_id"]: r for r in trees.collect()}
        assert [rows[i]["text"] for i in range(4)] == texts
        assert [rows[i]["n_tokens"] for i in range(4)] == [len(full(t)) for t in texts]
        assert all(sum(rows[i]["counts"]) == rows[i]["n_tokens"] and sum(rows[i]["lengths"]) == len(texts[i]) for i in range(4))
        assert max(r["n_reencoded"] for r in rows.values()) < 60  # of up to 20,000 pre-tokens
        trees = trees.drop("n_reencoded")
    assert token_counts.edit_counts(token_counts.attach_edits(documents(spark, texts).limit(0), listed)).count() == 0


def test_token_counts_of_odd_inputs(spark, odd):
    edits = spark.createDataFrame([(1, 1, 0, 5, "b"), (1, 2, None, None, None), (2, 1, 99, 9, "new")], "doc_id long, seq int, start long, length long, replacement string")
    rows = token_counts.edit_counts(token_counts.attach_edits(odd, edits)).collect()
    assert len(rows) == odd.count()
    assert {r["n_tokens"] for r in rows if r["doc_id"] == 1} == {0} and {r["n_chars_after"] for r in rows if r["doc_id"] == 1} == {1}


# 5 neighbours


def brute_neighbours(ids, x, queries, k):
    found = {}
    for q in queries:
        at = ids.index(q)
        dist = np.sqrt(((x - x[at]) ** 2).sum(axis=1))
        order = sorted((d, i) for d, i in zip(dist, ids, strict=True) if i != q)
        found[q] = [i for _, i in order[:k]]
    return found


def test_neighbour_recall(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()
    found = {}
    for r in QUERIES["op5_neighbours"](spark, "/root/testdata/sf0.01").collect():
        found.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    truth = brute_neighbours([r["vec_id"] for r in rows], np.array([r["embedding"] for r in rows], float), list(found), 10)
    assert np.mean([len(set(found[q].values()) & set(truth[q])) / 10 for q in found]) >= 0.9
    assert all(sorted(f) == list(range(1, 11)) for f in found.values())


def test_neighbours_of_odd_inputs(spark):
    rows = [(0, [1.0, 0.0]), (100, [0.0, 0.0]), (200, [float("nan"), 1.0]), (300, None), (400, [1.0, None]), (500, [1.0]), (None, [1.0, 1.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [3.0, 4.0])]
    vectors = neighbours.usable(spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("vec", F.lit(1)))
    asked = spark.createDataFrame([(0,), (100,), (400,)], "query_id long")
    found = [tuple(r) for r in neighbours.neighbours(vectors, asked).orderBy("rank").collect()]
    assert found == [(0, 1, 1, 0.0), (0, 2, 2, float(np.sqrt(20.0)))]
    nothing = neighbours.usable(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert neighbours.neighbours(nothing, asked).count() == 0


def test_neighbours_in_many_small_groups_and_among_copies(spark):
    """Groups smaller than the lists have no links out; a third of all rows is one vector; ties go to smaller ids."""
    rng = np.random.default_rng(9)
    x = np.concatenate([np.repeat(rng.normal(size=(80, 16)), 15, axis=0) + 0.001 * rng.normal(size=(1_200, 16)), np.ones((600, 16))])
    ids = rng.permutation(len(x)).tolist()
    vectors = neighbours.usable(spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>"))
    asked = [i for i in ids if i % 50 == 0]
    found = {}
    for r in neighbours.neighbours(vectors, spark.createDataFrame([(q,) for q in asked], "query_id long")).collect():
        found.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    truth = brute_neighbours(ids, x, asked, 10)
    assert np.mean([len(set(found[q].values()) & set(truth[q])) / 10 for q in asked]) >= 0.97
    copies = [q for q in asked if ids.index(q) >= 1_200]
    assert copies and all([found[q][r] for r in range(1, 11)] == truth[q] for q in copies)


@pytest.mark.parametrize("offset, scale", [(1000.0, 0.1), (0.0, 1e6)])
def test_neighbour_lists_of_offset_and_large_vectors(spark, offset, scale):
    x = offset + scale * np.random.default_rng(5).normal(size=(60, 8))
    vectors = neighbours.usable(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"))
    graph = neighbours.merged_lists(neighbours._as_merged(neighbours.first_lists(vectors, 60, neighbours.centring(vectors)), False))
    got = {r["node"]: r["ids"][:5] for r in graph.collect()}
    truth = brute_neighbours(list(range(60)), x, list(range(60)), 5)
    assert np.mean([len(set(got.get(q, [])) & set(truth[q])) / 5 for q in truth]) > 0.95


# 6 suffix dedup


def repeat_masks(texts, length=400):
    raws = [(t or "").encode() for t in texts]
    seen = {}
    for raw in raws:
        for i in range(len(raw) - length + 1):
            seen[raw[i : i + length]] = seen.get(raw[i : i + length], 0) + 1
    for raw in raws:
        mask = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            if seen[raw[i : i + length]] > 1:
                mask[i : i + length] = b"\1" * length
        yield raw, mask


def brute_removal(texts, length=400):
    found = []
    for raw, mask in repeat_masks(texts, length):
        kept = bytes(b for b, m in zip(raw, mask, strict=True) if not m)
        found.append((len(raw), len(raw) - len(kept), sum(1 for i, m in enumerate(mask) if m and (i == 0 or not mask[i - 1])), hashlib.sha256(kept).hexdigest()))
    return found


def brute_cut(texts, length):
    """texts without the repeated strings; of a character all bytes go or none."""
    cut = []
    for text, (_, mask) in zip(texts, repeat_masks(texts, length), strict=True):
        at, kept = 0, []
        for c in text or "":
            size = len(c.encode())
            kept += [c] if not all(mask[at : at + size]) else []
            at += size
        cut.append("".join(kept) if text is not None else None)
    return cut


def passages():
    rng = random.Random(6)
    noise = lambda n: "".join(rng.choices("abcdefghij é", k=n))
    shared, other = noise(700), noise(399)
    return [
        noise(300) + shared + noise(200), noise(50) + shared[100:600], shared[:450] + noise(100) + shared[300:], other, other, noise(90) + other, "z" * 1000, "z" * 401, "z" * 400,
        ("xy" * 300) + noise(30), None, "", noise(2000), noise(2000), *(noise(60) + shared[150:640] + noise(60) for _ in range(6)),
    ]


@pytest.mark.parametrize("hot", [4_096, 2])
def test_suffix_dedup_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    texts = passages()
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.removal_report(documents(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_removal(texts)


@pytest.mark.parametrize("length", [60, 200, 400])
def test_suffix_dedup_cuts_passages_of_a_length(spark, length):
    texts = passages() + [f"{'é' * n}{'plain words of the passage ' * 3}{n}" for n in range(3)]
    rows = {r["doc_id"]: r["text"] for r in suffix_dedup.without_repeats(documents(spark, texts), length).collect()}
    assert [rows[i] for i in range(len(texts))] == brute_cut(texts, length)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.removal_report(documents(spark, texts), length).collect()}
    assert [got[i] for i in range(len(texts))] == brute_removal(texts, length)


def test_suffix_dedup_cuts_a_passage_of_51_words_from_every_document(spark):
    rng = random.Random(3)
    some = lambda n: " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 6))) for _ in range(n))
    passage = some(51)
    texts = [f"{some(40)} {passage} {some(30)}" for _ in range(25)] + [some(90) for _ in range(25)]
    rows = {r["doc_id"]: r["text"] for r in suffix_dedup.without_repeats(documents(spark, texts)).collect()}
    assert all(passage not in rows[i] and len(rows[i].split()) >= 68 for i in range(25))
    assert all(rows[i] == texts[i] for i in range(25, 50))


def test_suffix_dedup_cuts_long_texts_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 1_000)
    texts = passages()
    pieces = suffix_dedup.cover(documents(spark, texts).select(F.col("doc_id").alias("k1"), F.lit(0).cast("long").alias("k2"), F.coalesce("text", F.lit("")).alias("text")))
    assert pieces.agg(F.sum(F.col("width") * F.col("n"))).first()[0] == sum(max(len((t or "").encode()) - 399, 0) for t in texts)


def test_suffix_dedup_of_odd_inputs(spark, odd):
    cleaned = suffix_dedup.without_repeats(odd.withColumn("n_chars", F.lit(1).cast("long")))
    assert cleaned.columns == [*odd.columns, "n_chars"] and cleaned.count() == odd.count()
    assert cleaned.filter("text IS NULL").count() == odd.filter("text IS NULL").count()
    assert cleaned.filter("n_chars <> length(text)").count() == 0
    assert suffix_dedup.removal_report(odd.limit(0)).count() == 0


# 7 near duplicates


def edited(rng, ws, edits):
    ws = list(ws)
    for _ in range(edits):
        ws[rng.randrange(len(ws))] = f"new{rng.randrange(10**6)}"
    return " ".join(ws)


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(7)
    texts = []
    for _ in range(25):
        base = [f"v{rng.randrange(3000)}" for _ in range(rng.choice([30, 120, 400]))]
        texts += [" ".join(base)] * rng.choice([1, 2]) + [edited(rng, base, rng.choice([1, 2, 3, 8])) for _ in range(rng.choice([1, 3]))]
    texts += ["", None, "one two", "one two", "One, two!", "x"]
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))) if w else frozenset() for w in map(words, texts)]
    parent = list(range(len(texts)))
    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i in range(len(texts)):
        for j in range(i):
            same = (texts[i] or "") == (texts[j] or "")
            union = len(sets[i] | sets[j])
            if same or union and len(sets[i] & sets[j]) / union >= 0.8:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(documents(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == [find(i) for i in range(len(texts))]
    kept = sorted(r["doc_id"] for r in near_dedup.keep_one(documents(spark, texts)).collect())
    assert kept == sorted({find(i) for i in range(len(texts))})


def test_a_large_group_of_near_copies_makes_few_pairs(spark):
    rng = random.Random(8)
    base = [f"v{i}" for i in range(300)]
    docs = documents(spark, [" ".join(base)] + [edited(rng, base, 2) for _ in range(600)])
    classes = near_dedup.signatures(docs, ["doc_id"]).withColumnRenamed("doc_id", "class_id")
    assert near_dedup.candidate_pairs(classes).count() < 25 * 601
    assert near_dedup.near_duplicates(docs).select("class_id").distinct().count() == 1


def bridged_groups():
    """Two tight groups that only one pair at about 0.81 connects; both its ends have a nearer copy, the centre of their group."""
    rng = random.Random(11)
    change = lambda ws, places, tag: [f"{tag}{i}" if i in places else w for i, w in enumerate(ws)]
    near = [f"v{i}" for i in range(1_000)]
    groups = []
    for bridge, tag in ((near, "l"), (change(near, set(range(100, 200)), "far"), "r")):
        centre = change(bridge, {400 if tag == "l" else 600}, tag)
        groups += [" ".join(bridge), " ".join(centre), *(" ".join(change(centre, {rng.randrange(700, 990)}, f"{tag}{i}x")) for i in range(11))]
    return groups


@pytest.mark.parametrize("block", [1_024, 4])
def test_every_link_of_a_bridged_group_counts(spark, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    texts = bridged_groups()
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) for w in map(words, texts)]
    alike = [[i != j and len(a & b) / len(a | b) >= 0.8 for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    across = sum(alike[i][j] for i in range(13) for j in range(13, 26))
    assert 0 < across < 13 * 13
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in near_dedup.near_duplicates(documents(spark, texts)).collect()}
    assert [got[i] for i in range(26)] == [(0, sum(row)) for row in alike]


def test_weighted_sets_through_near_duplicates(spark):
    """Weights by count change which pairs meet; what is linked is decided on the sets."""
    rng = random.Random(13)
    bases = [[f"v{rng.randrange(4000)}" for _ in range(120)] for _ in range(6)]
    texts = [" ".join(b) for b in bases] + [edited(rng, b, 1) for b in bases] + [" ".join(bases[0] * 3), " ".join(bases[1] + bases[1][:60])]
    found = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(documents(spark, texts), weighted=True).collect()}
    assert [found[i] for i in range(12)] == [*range(6), *range(6)]
    assert len(found) == len(texts) and all(found[i] in (i, i - 12) for i in (12, 13))


def test_registers_estimate_weighted_similarity():
    rng = np.random.default_rng(9)
    a, b = rng.integers(1, 50, 400).astype(float), rng.integers(1, 50, 400).astype(float)
    codes = near_dedup.mixed(np.arange(1, 401, dtype=np.uint64))
    agree = []
    for shift in range(40):
        own = near_dedup.mixed(codes + np.uint64(shift * 1000))
        registers = near_dedup.prob_min_hash(np.repeat([0, 1], 400), np.tile(own, 2), np.concatenate([a, b]), 2)
        agree.append((registers[0] == registers[1]).mean())
    wanted = sum(1 / np.maximum(a / a[i], b / b[i]).sum() for i in range(400))
    assert np.mean(agree) == pytest.approx(wanted, abs=0.03)


def test_near_duplicates_of_odd_inputs(spark, odd):
    found = near_dedup.near_duplicates(odd).collect()
    assert len(found) == odd.count() and all(r["class_id"] is None for r in found if r["doc_id"] is None)
    assert near_dedup.keep_one(odd).columns == odd.columns
    assert near_dedup.near_duplicates(odd.limit(0)).count() == 0


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101), (7, 7)], "a long, b long")
    found = {r["node"]: r["component"] for r in components(edges).collect()}
    assert found == {**{i: 0 for i in range(51)}, 100: 100, 101: 100}


# 8 licences


def test_licences_match_whole_texts_only(spark):
    mit = next(t for name, t in KNOWN if name == "MIT")
    variants = ["Copyright (c) 2020 Someone\n\n" + mit.replace("sublicense", "sub-license").upper(), mit + " And more.", mit.replace('"', "“"), None, "", "© me"]
    found = {r["doc_id"]: r["licence_id"] for r in license_scan.scan(documents(spark, variants), license_scan.known_digests(spark, KNOWN)).collect()}
    assert [found[i] for i in range(6)] == ["MIT", None, "MIT", None, None, None]


def test_licences_of_odd_inputs(spark, odd):
    known = license_scan.known_digests(spark, KNOWN)
    rows = license_scan.scan(odd, known)
    assert rows.columns == ["doc_id", "digest", "licence_id"] and rows.count() == odd.count()
    assert rows.filter("licence_id IS NOT NULL").count() == 0
    assert rows.filter("digest IS NULL").count() == 2 * sum(not re.search(r"\w", t or "") for t in ODD_TEXTS)
    assert license_scan.scan(odd.limit(0), known).count() == 0
    mit = next(t for name, t in KNOWN if name == "MIT")
    near_misses = [mit[:-1] + " x", mit.replace("without restriction", "with restriction"), mit * 2, "The MIT License is near"]
    assert license_scan.scan(documents(spark, near_misses), known).filter("licence_id IS NOT NULL").count() == 0
    assert license_scan.scan(documents(spark, [mit] * 3), known).filter("licence_id = 'MIT'").count() == 3


@pytest.mark.skipif(not Path("/usr/share/common-licenses/GPL-3").exists(), reason="no licence texts on this machine")
def test_whole_texts_of_long_licences_are_known(spark):
    folder = Path("/usr/share/common-licenses")
    wanted = {"Apache-2.0": "Apache-2.0", "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    docs = documents(spark, [(folder / name).read_text() for name in wanted])
    found = {r["doc_id"]: r["licence_id"] for r in license_scan.scan(docs, license_scan.known_digests(spark, KNOWN)).collect()}
    assert [found[i] for i in range(len(wanted))] == list(wanted.values())


# 9 SentencePiece


def unigram_file(path, charsmap, squeeze, fallback, dummy=True):
    """A Unigram model written field by field: pieces with scores, the trainer's and the normaliser's settings."""

    def varint(n):
        return bytes([n]) if n < 128 else bytes([n & 127 | 128]) + varint(n >> 7)

    def field(number, value):
        if isinstance(value, bytes):
            return varint(number << 3 | 2) + varint(len(value)) + value
        return varint(number << 3 | 5) + struct.pack("<f", value) if isinstance(value, float) else varint(number << 3) + varint(value)

    listed = "▁the ▁of ▁and th he in er an ▁a ▁t ing tion es ▁ e t a o i n s r h l d u c m f é 日 ▁re re on ffi 1 2 3 A B".split(" ")
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *((f"<0x{i:02X}>", 0.0, 6) for i in range(256) if fallback), *((w, -1.0 - 0.37 * i, 1) for i, w in enumerate(listed))]
    data = b"".join(field(1, field(1, p.encode()) + field(2, s) + field(3, k)) for p, s, k in pieces) + field(2, field(3, 1) + field(35, int(fallback)))
    path.write_bytes(data + field(3, field(2, charsmap) + field(3, int(dummy)) + field(4, int(squeeze)) + field(5, 1)))
    return str(path)


@pytest.mark.parametrize("mapped", [True, False])
@pytest.mark.parametrize("fallback", [True, False])
@pytest.mark.parametrize("squeeze", [True, False])
@pytest.mark.parametrize("dummy", [True, False])
def test_unigram_parity(tmp_path, mapped, fallback, squeeze, dummy):
    rules = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto()
    charsmap = dict(sentencepiece_codec.fields(dict(sentencepiece_codec.fields(rules))[3]))[2] if mapped else b""
    path = unigram_file(tmp_path / "unigram.model", charsmap, squeeze, fallback, dummy)
    ours, theirs = sentencepiece_codec.Encoder(path), sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(9)
    parts = ["the", " ", "  ", "other", "relation", "é", "日本", "Ａ", "ﬃ", "ﬁ", "¼", "①", "\xa0", "\u3000", "\t", "\n", "▁", "\u200b", "123", "xyz"]
    texts = ["", " ", "\xa0the\u3000of", *("".join(rng.choices(parts, k=rng.randint(1, 25))) for _ in range(300))]
    ids = [np.frombuffer(x, "<i4").tolist() for x in ours.encode(texts)]
    assert ids == theirs.encode(texts)
    loose = [rng.choices(range(theirs.vocab_size()), k=rng.randint(1, 12)) for _ in range(300)]  # ids that no encoder makes
    assert ours.decode(ids + loose) == [theirs.decode(x) for x in ids + loose]


def test_sentencepiece_parity(spark, odd):
    texts = [*ODD_TEXTS, "  a  b ", " lead", "trail ", "▁x ▁", "<s></s><unk>", "<0x41>", "日本語   ok", "tab\tnew\nline", "퟿"]
    rows = sentencepiece_codec.encode_report(documents(spark, texts)).collect()
    assert all(r["parity"] for r in rows) and all(r["round_trip"] for r, t in zip(sorted(rows), texts, strict=True) if "▁" not in (t or ""))
    ids = sentencepiece_codec.encode(documents(spark, texts), ["doc_id"])
    back = {r["doc_id"]: r["text"] for r in sentencepiece_codec.decode(ids, ["doc_id"]).collect()}
    assert [back[i] for i in range(len(texts))] == [(t or "").replace("▁", " ") for t in texts]
    assert sentencepiece_codec.encode_report(odd).count() == odd.count()


# 10 language


def test_language_on_held_out_documents(spark):
    scored = QUERIES["op10_language_id"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in scored)
    assert np.mean([r["lang"] == r["lang_pred"] for r in scored]) > 0.95


def test_language_against_plain_compression(spark):
    known = {"de": "der die das und nicht ein eine mit auf für " * 40, "en": "the and of to in that with this was for " * 40, "fr": "le la les et des une pour dans que qui " * 40}
    known = {name: text.encode() for name, text in known.items()} | {"zz": b"the and of to in that with this was for " * 40}
    rng = random.Random(10)
    words_of = {name: text.decode().split() for name, text in known.items()}
    texts = [" ".join(rng.choices(words_of[rng.choice(["de", "en", "fr"])], k=rng.randint(1, 60))).title() for _ in range(60)] + ["", None, "123 !", "x"]
    got = {r["doc_id"]: r for r in language_id.classify(documents(spark, texts), known, ["doc_id"]).collect()}
    for i, text in enumerate(texts):
        if not re.search(r"[^\W\d_]", text or ""):
            assert (got[i]["lang_pred"], got[i]["score"], got[i]["rejected"]) == ("und", 0.0, False)
            continue
        sizes = {}
        for name, content in known.items():
            packer = zstandard.ZstdCompressor(level=language_id.LEVEL, dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_checksum=False)
            sizes[name] = len(packer.compress(text.lower().encode()))
        first, second = sorted((size, name) for name, size in sizes.items())[:2]
        assert got[i]["lang_pred"] == first[1]  # "en" before its equal "zz": ties go to the name that sorts first
        assert got[i]["score"] == pytest.approx(1 - first[0] / second[0])
        assert got[i]["rejected"] == (got[i]["score"] < language_id.MIN_MARGIN)


def test_language_sample_takes_repeated_rows_once(spark):
    rows = [(None, "same words again and again", "en")] * 500 + [(i, f"text number {i} of many", "en") for i in range(20)] + [(1, "une phrase", "fr"), (2, "rien", None)]
    known = language_id.train_dictionaries(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert sorted(known) == ["en", "fr"] and known["fr"] == b"une phrase"
    assert known["en"].count(b"same words again and again") == 1 and known["en"].count(b"text number") == 20


def test_language_of_odd_inputs(spark, odd):
    known = language_id.train_dictionaries(odd)
    found = language_id.classify(odd.drop("score"), known, ["doc_id"]).collect()
    assert len(found) == odd.count() and {r["lang_pred"] for r in found} == {"und", "en"}
    nothing = language_id.classify(odd, language_id.train_dictionaries(odd.limit(0)), ["doc_id"]).collect()
    assert {r["lang_pred"] for r in nothing} == {"und"}


# Pipeline


def test_pipeline_stages_on_planted_cases(spark, tmp_path):
    import corpus_pipeline

    source = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{source}/documents.parquet")
    last = corpus_pipeline.run(spark, source)
    assert 0.5 * docs.count() < last.count() < docs.count()
    assert last.filter("NOT parity OR NOT round_trip").count() == 0
    kept = docs.join(last.select("doc_id"), "doc_id", "left_semi")
    assert near_dedup.near_duplicates(kept).filter("doc_id <> class_id").count() == 0
    bench = spark.read.parquet(f"{source}/benchmark.parquet")
    item = bench.first()["text"]
    planted = docs.filter("doc_id = 1").withColumn("text", F.concat("text", F.lit(" "), F.lit(item))).unionByName(docs.filter("doc_id = 4"))
    assert [r["doc_id"] for r in corpus_pipeline.decontaminate(spark, planted, source).collect()] == [4]
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "near dedup", "suffix dedup", "decontamination", "sentencepiece"]


def test_each_stage_against_brute_force_on_its_own_input(spark, tmp_path):
    """Near dedup, suffix dedup, decontamination and encoding, each on what the stage before it kept."""
    import corpus_pipeline

    rng = random.Random(12)
    some = lambda n: [f"{rng.choice('abcdefgh')}{rng.randrange(10**5)}" for _ in range(n)]
    passage, items = some(55), [" ".join(some(14)) for _ in range(3)]
    bases = [some(rng.choice([30, 90, 200])) for _ in range(24)]
    texts = [" ".join(b) for b in bases] + [edited(rng, b, 2) for b in bases[:8]] + [" ".join(bases[9]), "", None]
    texts += [" ".join([*some(40), *passage, *some(30)]) for _ in range(6)] + [" ".join([*some(25), item, *some(25)]) for item in items]
    spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")

    kept = corpus_pipeline.near_dedup(spark, docs, str(tmp_path)).orderBy("doc_id").collect()
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))) if w else frozenset() for w in map(words, texts)]
    alike = lambda i, j: (texts[i] or "") == (texts[j] or "") or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) > 0
    assert [r["doc_id"] for r in kept] == [i for i in range(len(texts)) if not any(alike(i, j) for j in range(i))]

    docs = spark.createDataFrame(kept, docs.schema)
    cut = {r["doc_id"]: r for r in corpus_pipeline.suffix_dedup(spark, docs, str(tmp_path)).collect()}
    wanted = brute_cut([r["text"] for r in kept], suffix_dedup.PASSAGE)
    assert [cut[r["doc_id"]]["text"] for r in kept] == wanted and all(" ".join(passage) not in (t or "") for t in wanted)
    assert all(r["n_chars"] == len(r["text"] or "") for r in cut.values() if r["text"] is not None)

    docs = spark.createDataFrame(list(cut.values()), docs.schema)
    clean = corpus_pipeline.decontaminate(spark, docs, str(tmp_path)).collect()
    hits = brute_contamination([r["text"] for r in cut.values()], list(enumerate(items)))
    assert sorted(r["doc_id"] for r in clean) == sorted(i for i, hit in zip(cut, hits, strict=True) if not hit[1]) and len(clean) < len(cut)

    theirs = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL)
    encoded = {r["doc_id"]: r for r in corpus_pipeline.sentencepiece(spark, spark.createDataFrame(clean, docs.schema), str(tmp_path)).collect()}
    assert {r["doc_id"]: len(theirs.encode(r["text"] or "")) for r in clean} == {i: r["n_pieces"] for i, r in encoded.items()}
    assert all(r["parity"] and r["round_trip"] for r in encoded.values())
    nothing = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, nothing, str(tmp_path)).count() == 0
