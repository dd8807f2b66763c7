"""Hard negatives, whitening and URL filters against brute force, planted cases and odd inputs."""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loam.llm import hard_negatives, url_filter, whitening
from loam.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
NAN, INF = float("nan"), float("inf")


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>, score double, id string, place int")


def rows_of(x, labels, ids=None):
    return [(int(i), int(y), [float(c) for c in v], -1.0, "x", 7) for i, v, y in zip(range(len(x)) if ids is None else ids, x, labels, strict=True)]


# 11 hard negatives


def brute_negatives(rows, divisor=50, least=50, most=95):
    held = {i: (y, np.array([int(c) for c in np.floor(256 * np.array(v, "f4").astype("f8"))], object)) for i, y, v, *_ in rows}
    found = set()
    for a, (y, v) in held.items():
        if a % divisor:
            continue
        scores = sorted((-int((v * w).sum()), i, z) for i, (z, w) in held.items() if i != a)
        for s, p, _ in [x for x in scores if x[2] == y][:5]:
            fits = [(t, i) for t, i, z in scores if z != y and least * -s <= 100 * -t <= most * -s][:3]
            found |= {(a, p, r, i, -s, -t) for r, (t, i) in enumerate(fits, 1)}
    return found


def mined(df, divisor=50):
    rows = hard_negatives.hard_negatives(df, F.col("vec_id") % divisor == 0).collect()
    found = {tuple(r) for r in rows}
    assert len(found) == len(rows)
    return found


@pytest.mark.parametrize("block, asked, group, spread", [(2_048, 256, 64, 1.0), (64, 8, 2, 0.05)])
def test_hard_negatives_against_brute_force(spark, monkeypatch, block, asked, group, spread):
    """Loose groups as they come, and tight ones in small blocks and several passes; both with copies and ties."""
    monkeypatch.setattr(hard_negatives, "BLOCK", block)
    monkeypatch.setattr(hard_negatives, "ASKED", asked)
    monkeypatch.setattr(hard_negatives, "GROUP", group)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(12, 8))[rng.integers(0, 12, 700)] + spread * rng.normal(size=(700, 8))
    x[100:160] = x[100]  # a group of copies under several labels, anchors among them
    x[300:340] = np.round(x[300:340])
    rows = rows_of(x, rng.integers(0, 4, 700))
    assert mined(vectors(spark, rows), 10) == brute_negatives(rows, 10)


def test_brackets_spare_tight_groups_most_exact_scores():
    """On 40 tight groups far apart no more than a tenth of the pairs are scored; brackets hold for every pair."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 16))
    x = (centres / np.linalg.norm(centres, axis=1)[:, None])[np.arange(2_000) % 40] + 0.005 * rng.normal(size=(2_000, 16))
    x = np.floor(256 * x).astype(np.int64)
    norms = (x**2).sum(axis=1)
    pivots = hard_negatives.Pivots(x[:16].astype("f8"), norms.max())
    search = hard_negatives.Search(pivots, True, 6, 1)
    q = x[:100]
    scores = q @ x.T
    floors = np.sort(scores, axis=1)[:, -6]
    query = [np.arange(100), np.zeros(100, np.int64), q, norms[:100].astype("f8"), pivots.of_queries(q.astype("f8"), norms[:100]), np.stack([floors, np.full(100, hard_negatives.HIGHEST)], axis=1)]
    search.meet(0, query, [np.arange(2_000), np.zeros(2_000, np.int64), x, norms, pivots.of_rows(x.astype("f8"), norms.astype("f8")), np.zeros(0)])
    assert search.met == 200_000 and search.scored <= 0.1 * search.met
    assert (search.held[0][1][:, 0] == -np.sort(-scores, axis=1)[:, :6]).all()


def test_hard_negatives_of_odd_inputs(spark):
    rng = np.random.default_rng(5)
    rows = rows_of(rng.normal(size=(120, 4)), rng.integers(0, 3, 120))
    odd = [(None, 1, [1.0] * 4, 0.0, "x", 1), (1_000, None, [1.0] * 4, 0.0, "x", 1), (1_001, 1, None, 0.0, "x", 1), (1_002, 1, [1.0, None, 1.0, 1.0], 0.0, "x", 1),
           (1_003, 1, [1.0, NAN, 1.0, 1.0], 0.0, "x", 1), (1_004, 1, [1.0, INF, 1.0, 1.0], 0.0, "x", 1), (1_005, 1, [], 0.0, "x", 1), (1_006, 1, [3e38] * 4, 0.0, "x", 1)]
    assert mined(vectors(spark, rows + odd + rows[:10])) == brute_negatives(rows)
    short = rows_of(rng.normal(size=(60, 3)), rng.integers(0, 2, 60), range(2_000, 2_060))
    assert mined(vectors(spark, rows + short)) == brute_negatives(rows) | brute_negatives(short)
    large = rows_of(rng.normal(size=(80, 3)) * 1e6, rng.integers(0, 2, 80))  # products over 2**53
    assert mined(vectors(spark, large)) == brute_negatives(large)
    for few in (rows[:1], rows[:3], []):
        assert mined(vectors(spark, few)) == brute_negatives(few)
    shared = [(0, 2, [9.0] * 4, 0.0, "x", 1), *rows]  # the smaller label of an id counts
    assert mined(vectors(spark, shared)) == brute_negatives([min(shared[:2], key=lambda r: (r[1], r[2])), *rows[1:]])


def test_session_settings_come_back(spark):
    names = ["spark.sql.parquet.columnarReaderBatchSize", "spark.sql.execution.arrow.maxBytesPerBatch"]
    before = [spark.conf.get(n) for n in names]
    spark.conf.set(names[0], "4096")
    mined(vectors(spark, rows_of(np.eye(4), [0, 0, 1, 1])))
    assert spark.conf.get(names[0]) == "4096"
    for n, v in zip(names, before, strict=True):
        spark.conf.set(n, v)


# 12 whitening


def brute_whitening(x):
    u = np.unique(x, axis=0)
    n, sums = len(u), u.sum(axis=0)
    c = (n * u - sums).astype("f8") / n
    values, axes = np.linalg.eigh(c.T @ c / n)
    return n, sums, values[::-1], axes[:, ::-1], (n * x - sums).astype("f8") / n


def test_whitening_against_numpy(spark):
    df = spark.read.parquet(f"{SF_DIR}/embeddings.parquet")
    many = df.unionByName(df.filter("vec_id < 5")).unionByName(df.withColumn("vec_id", F.col("vec_id") + 10_000).filter("vec_id < 10100"))  # copies under their own and other ids
    rows = many.collect()
    x = np.floor(64 * np.array([r["embedding"] for r in rows])).astype(np.int64) + 1_000_000
    n, sums, values, axes, centred = brute_whitening(x)
    found, fitted, error = whitening.whitened(many)
    got = defaultdict(list)
    for r in found.collect():
        got[r["vec_id"]].append(r)
    assert sum(map(len, got.values())) == len(rows) and fitted.n == n and error < 1e-9
    wanted = centred @ axes[:, :16] / np.sqrt(values[:16])
    signs = np.sign((wanted * np.array([got[r["vec_id"]][0]["whitened"] for r in rows])).sum(axis=0))
    for row, w, lattice in zip(rows, wanted, x, strict=True):
        for r in got[row["vec_id"]]:
            assert np.allclose(r["whitened"], w * signs, atol=1e-8)
            assert r["deviation"] == sum((n * int(a) - int(b)) ** 2 for a, b in zip(lattice, sums, strict=True))
    assert np.allclose(fitted.values, values[:16]) and math.isclose(fitted.total, values.sum(), rel_tol=1e-9)


def test_whitening_query(spark):
    rows = QUERIES["op12_whitening"](spark, SF_DIR).collect()
    assert len(rows) == 16 * 500 and len({(r["vec_id"], r["component"]) for r in rows}) == len(rows)
    assert {r["n"] for r in rows} == {500} and all(0 <= r["identity_error"] <= 1e-9 for r in rows)
    shares = [next(r["explained"] for r in rows if r["component"] == k) for k in range(1, 17)]
    assert shares == sorted(shares, reverse=True) and 0 < sum(shares) < 1


def test_whitening_far_from_the_origin_and_of_few_dimensions(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 11)) @ rng.normal(size=(11, 11)) + 5_000
    found, fitted, error = whitening.whitened(vectors(spark, rows_of(x, [0] * 400)))
    lattice = np.floor(64 * x.astype("f4").astype("f8")).astype(np.int64) + 1_000_000
    _, _, values, _, _ = brute_whitening(lattice)
    assert len(fitted.values) == 11 and np.allclose(fitted.values, values, rtol=1e-8) and error < 1e-8
    assert {len(r["whitened"]) for r in found.collect()} == {11}


def test_whitening_of_odd_inputs(spark):
    rng = np.random.default_rng(7)
    rows = rows_of(rng.normal(size=(50, 3)), [0] * 50)
    odd = [(100, 1, None, 0.0, "x", 1), (101, 1, [], 0.0, "x", 1), (102, 1, [1.0, None, 0.0], 0.0, "x", 1), (103, 1, [NAN, 0.0, 0.0], 0.0, "x", 1), (104, 1, [INF, 0.0, 0.0], 0.0, "x", 1), (105, 1, [1.0, 2.0], 0.0, "x", 1)]
    found, fitted, _ = whitening.whitened(vectors(spark, [*rows, *odd, (None, 1, rows[0][2], 0.0, "x", 1), rows[0]]))
    assert fitted.n == 50 and Counter(r["vec_id"] for r in found.collect()) == Counter([*range(50), None, 0])
    flat = rows_of(np.outer(np.arange(20), [1.0, 2.0, 0.0]), [0] * 20)  # one direction only
    found, fitted, error = whitening.whitened(vectors(spark, flat))
    assert len(fitted.values) == 1 and error < 1e-9 and found.count() == 20
    for few in (rows[:1], [rows[0]] * 3, []):
        found, fitted, _ = whitening.whitened(vectors(spark, few))
        assert fitted is None and found.count() == 0
    huge = rows_of([[1e30, 0.0], [0.0, 1.0], [-1e30, 2.0]], [0] * 3)
    found, fitted, _ = whitening.whitened(vectors(spark, huge))
    assert all(r["deviation"] is None for r in found.collect() if r["vec_id"] != 1) and fitted.n == 3


# 13 URL filter


def pages(spark, urls):
    return spark.createDataFrame([(i, u, "html", "h", 3) for i, u in enumerate(urls)], "page_id long, url string, html string, host string, bin int")


RULE_CASES = {
    "https://a.org/x": ("a.org", "/x", "org/"), "http://ORG/": ("org", "/", "org/"), "https://aorg/x": ("aorg", "/x", None), "https://a.org": ("a.org", "", None),
    "https://www.Example.org/es/1?x=/": ("www.example.org", "/es/1", "example.org/es/"), "https://example.org/ES/1": ("example.org", "/ES/1", "org/"), "https://example.org/en/19#top": ("example.org", "/en/19", "example.org/en/1"),
    "x://badexample.org/es/": ("badexample.org", "/es/", "org/"), "https://a.com/fr/": ("a.com", "/fr/", "com/fr/"), "https://a.com/fr?/": ("a.com", "/fr", None), "https://a.com/de/x://y.org/": ("a.com", "/de/x://y.org/", "com/de/"),
    "a.org/x": ("", "", None), "": ("", "", None), None: ("", "", None), "://org/": ("org", "/", "org/"), "https://a.org?x=1": ("a.org", "", None), "https://a.org:80/x": ("a.org:80", "/x", None), "https://x.org/\n/y": ("x.org", "/\n/y", "org/"),
}


@pytest.mark.parametrize("inline", [256, 0])
def test_rules(spark, inline):
    host, path = url_filter.host_and_path(F.col("url"))
    urls = pages(spark, list(RULE_CASES) * 2).select("page_id", "url", host.alias("host"), path.alias("path"))
    more = url_filter.rule_table(spark, [*url_filter.RULES, ("org", "/", "block"), ("a.org", None, "block"), ("", "/", "block")])
    verdicts = {h + p: v for h, p, v in url_filter.RULES} | {"org/": "block", None: None}  # of two verdicts block counts
    rows = url_filter.by_rules(urls, more, inline).collect()
    assert len(rows) == 2 * len(RULE_CASES)
    for r in rows:
        host, path, rule = RULE_CASES[r["url"]]
        assert (r["host"], r["path"], r["rule"], r["rule_verdict"]) == (host, path, rule, verdicts[rule])


def brute_probability(counts, window):
    """Witten-Bell of one class's counts of windows, by its definition."""
    p = 1 / url_filter.SYMBOLS
    for k in range(url_filter.ORDER + 1):
        context = window[url_filter.ORDER - k : -1]
        here = [(w[-1], c) for w, c in counts.items() if w[url_filter.ORDER - k : -1] == context]
        n = sum(c for _, c in here)
        if n >= url_filter.LEAST:
            p = (sum(c for s, c in here if s == window[-1]) + len({s for s, _ in here}) * p) / (n + len({s for s, _ in here}))
    return p


def test_models_against_their_definition(spark):
    urls = {"allow": ["https://ab.c/ab/1", "https://ab.c/ba/22", "http://AB.c/é%/"] * 2, "block": ["https://zz.c/x", "https://zz.c/xab"] * 3}
    labelled = spark.createDataFrame([(u, v) for v, us in urls.items() for u in us], "url string, rule_verdict string")
    model = url_filter.ratios(url_filter.window_counts(labelled))

    def windows(url):
        rest = url.split("://")[1].lower()
        s = [url_filter.EDGE] * 3 + [url_filter.ALPHABET.find(c) if c in url_filter.ALPHABET else url_filter.EDGE - 1 for c in rest] + [url_filter.EDGE]
        return [tuple(s[i : i + 4]) for i in range(len(s) - 3)]

    counts = {v: Counter(w for u in us for w in windows(u)) for v, us in urls.items()}
    asked = ["https://ab.c/ab/1", "https://zz.c/xy", "https://new.host/path?q"]
    asked_rows = spark.createDataFrame(list(enumerate(asked)), "row long, url string")
    got = url_filter.scored(asked_rows, model).join(asked_rows, "row").orderBy("row").collect()
    for r in got:
        ratios = [round(1e6 * (math.log(brute_probability(counts["allow"], w)) - math.log(brute_probability(counts["block"], w)))) for w in windows(r["url"])]
        assert r["bin"] == math.floor(sum(ratios) / len(ratios) / 1e4)
    assert got[0]["bin"] > 0 > got[1]["bin"]


def test_held_out_urls_are_judged_as_their_rules_say(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    rows = url_filter.judged(df, url_filter.rule_table(spark)).join(df.select("page_id", "url"), "page_id").filter("rule IS NOT NULL").filter(url_filter.is_held(F.col("url")))
    right = rows.agg(F.count("*").alias("n"), F.count_if((F.col("verdict") == "allow") == (F.col("bin") >= F.col("threshold"))).alias("ok")).first()
    assert right["n"] > 100 and right["ok"] >= 0.97 * right["n"]


def test_threshold_is_the_least_balanced_error(spark):
    held = lambda rows: spark.createDataFrame(rows, "bin int, rule_verdict string")
    assert url_filter.threshold(held([(5, "allow"), (9, "allow"), (1, "block"), (2, "block"), (7, "block")])) == 3
    assert url_filter.threshold(held([(5, "allow")])) == 0 == url_filter.threshold(held([]))


def test_urls_of_odd_inputs(spark):
    long = "https://a.net/" + "x/" * 200_000
    odd = [None, "", "://", "no scheme", long, "https://日本.net/é", "https://a.net/\x00\n"] * 2
    rows = url_filter.judged(pages(spark, odd + ["https://a.org/x", "https://b.com/de/1"] * 30), url_filter.rule_table(spark)).collect()
    assert len(rows) == len(odd) + 60 and {r["verdict"] for r in rows} <= {"allow", "block"}
    assert next(r["path"] for r in rows if r["page_id"] == 4) == "/" + "x/" * 200_000
    unlabelled = url_filter.judged(pages(spark, odd), url_filter.rule_table(spark)).collect()
    assert [r["verdict"] for r in unlabelled] == ["allow"] * len(odd)
    assert url_filter.judged(pages(spark, []), url_filter.rule_table(spark)).count() == 0
