"""Changes of a new chunking against a plain version."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest

from loam.operators import rechunk

CHUNKS = "document_id long, place long, content string"


def plainly(old, new):
    at: dict[tuple, list[list[int]]] = defaultdict(lambda: [[], []])
    for side, chunks in enumerate((old, new)):
        for d, place, content in sorted(chunks, key=lambda r: r[:2]):
            at[d, content][side].append(place)
    pairs, out = defaultdict(dict), set()
    for (d, _), (olds, news) in at.items():
        met = min(len(olds), len(news))
        pairs[d].update(zip(news[:met], olds[:met], strict=True))
        out |= {(d, p, None, "removed") for p in olds[met:]} | {(d, None, p, "added") for p in news[met:]}
    for d, matched in pairs.items():
        best: list[int] = []
        for p in sorted(matched):
            if matched[p] != p and matched.get(p - 1, -9) != matched[p] - 1:
                run = [p]
                while matched.get(run[-1] + 1) == matched[run[-1]] + 1:
                    run.append(run[-1] + 1)
                best = run if len(run) > len(best) else best
        out |= {(d, o, p, "kept" if o == p else "shifted" if p in best else "moved") for p, o in matched.items()}
    return out


def random_chunks(rng):
    old, new = [], []
    for d in range(25):
        texts = [rng.choice(["a", "b", None, ""]) if rng.random() < 0.4 else f"t{rng.random()}" for _ in range(rng.randint(0, 40))]
        later = list(texts)
        for _ in range(rng.randint(0, 3)):
            i, j = sorted(rng.choices(range(len(later) + 1), k=2))
            later = rng.choice([later[:i] + later[j:], later[j:] + later[:j], later[:i] + ["x", "y"] + later[i:], later[i:j] + later[:i] + later[j:]])
        old += [(d, n, t) for n, t in enumerate(texts)]
        new += [(d, n, t) for n, t in enumerate(later)]
    return old, new


@pytest.mark.parametrize("seed", range(3))
def test_changes_equal_the_plain_version(spark, seed):
    old, new = random_chunks(random.Random(seed))
    found = rechunk.changes(spark.createDataFrame(old, CHUNKS), spark.createDataFrame(new, CHUNKS)).collect()
    assert {tuple(r) for r in found} == plainly(old, new) and len(found) == len({tuple(r) for r in found})


def test_one_document_of_copies(spark):
    """A document that is a content repeated: nothing is lost."""
    old, new = [(0, n, "same") for n in range(3_000)], [(0, n, "same") for n in range(2_500)]
    found = rechunk.changes(spark.createDataFrame(old, CHUNKS), spark.createDataFrame(new, CHUNKS)).groupBy("change").count().collect()
    assert {r["change"]: r["count"] for r in found} == {"kept": 2_500, "removed": 500}


def test_embeddings_go_with_their_chunks(spark):
    old = spark.createDataFrame([(1, 0, "a", [1.0]), (1, 1, "b", [2.0]), (1, 2, "c", [3.0])], CHUNKS + ", embedding array<double>")
    new = spark.createDataFrame([(1, 0, "new"), (1, 1, "a"), (1, 2, "c"), (2, 0, "a")], CHUNKS)
    rows = rechunk.carried(new, rechunk.changes(old, new), old).collect()
    assert {(r["document_id"], r["place"]): r["embedding"] for r in rows} == {(1, 0): None, (1, 1): [1.0], (1, 2): [3.0], (2, 0): None}


def test_empty_sides(spark):
    none, one = spark.createDataFrame([], CHUNKS), spark.createDataFrame([(1, 0, "a")], CHUNKS)
    assert [tuple(r) for r in rechunk.changes(none, one).collect()] == [(1, None, 0, "added")]
    assert [tuple(r) for r in rechunk.changes(one, none).collect()] == [(1, 0, None, "removed")]
    assert rechunk.changes(none, none).count() == 0


def test_one_shuffle(spark):
    df = spark.createDataFrame([(1, 0, "a")], CHUNKS)
    found = rechunk.changes(df, df)
    found.collect()
    assert found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange hashpartitioning") <= 1
