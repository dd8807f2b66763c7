from __future__ import annotations

import uuid
from urllib.parse import parse_qsl, urldefrag, urlencode, urlparse, urlunparse

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loam.functions import text as T
from loam.functions.chunk import chunks, merged_sections
from loam.functions.html import clean, parse_page


def values(spark, rows, column, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(r,) for r in rows], schema).coalesce(1).select(column).collect()]


@pytest.mark.parametrize(("url", "wanted"), [
    ("HTTPS://Example.ORG/Apply/?utm_source=a&q=Big#top", "https://example.org/apply/?q=Big"),
    ("https://example.org/a/", "https://example.org/a"), ("https://example.org/a?x=&y=1", "https://example.org/a?y=1"), ("https://example.org/a?fbclid=1", "https://example.org/a"),
])
def test_normalize_url(spark, url, wanted):
    assert values(spark, [url], T.normalize_url(F.col("x"))) == [wanted]


def plainly_normalised(url):
    parts = urlparse(urldefrag(url)[0])
    pairs = [(k, v) for k, v in parse_qsl(parts.query) if k not in T.TRACKING_PARAMS]
    return urlunparse((parts.scheme.lower(), parts.netloc.lower(), parts.path.lower(), "", urlencode(pairs), "")).rstrip("/")


def test_normalize_url_gives_parameters_one_spelling(spark):
    queries = ["q=a%20b", "q=a+b", "q=a b", "q=%41%7e*_-.", "q=caf%C3%A9&r=é", "a=1&a=2&utm_source=x", "q=1=2&r", "=x&y=", "utm%5Fsource=x&z=%26", "q=%2B&p=100%25", ""]
    urls = [f"https://Example.org/Some/Path/?{q}#f" for q in queries]
    assert values(spark, urls, T.normalize_url(F.col("x"))) == [plainly_normalised(u) for u in urls]
    assert values(spark, ["https://a.org/x?q=100%&r=%zz"], T.normalize_url(F.col("x"))) == ["https://a.org/x?q=100%25&r=%25zz"]


def test_clean_text_matches_the_python_version(spark):
    raw = ["  a\x07  b \r\n\r\n\r\n\r\nc  ,d . ", "", "\n\n x \n", "plain"]
    assert values(spark, raw, T.clean_text(F.col("x"))) == [clean(x) for x in raw]


def test_chunk_id_is_a_uuid5(spark):
    found = spark.range(1).select(T.chunk_id(F.lit("doc"), F.lit(2), F.lit(1), F.lit("some text"))).first()[0]
    import hashlib

    key = f"doc:2:1:{hashlib.sha256(b'some text').hexdigest()}"
    assert found == str(uuid.uuid5(uuid.UUID(T.CHUNK_NAMESPACE), key))


def test_greetings_and_replies(spark):
    assert values(spark, ["Hi", "hello there", "history", "hi how are you today", "what?"], T.is_greeting(F.col("x"))) == [True, True, True, False, False]
    assert values(spark, ["Graduate", "first year", "no idea"], T.reply_student_type(F.col("x"))) == ["graduate", "freshman", None]


def test_undergraduate_is_not_graduate(spark):
    found = values(spark, ["Undergraduate admissions", "Graduate school"], F.array_join(T.student_types(F.lit(""), F.col("x")), "|"))
    assert found == ["", "graduate"]


def test_priority(spark):
    rows = spark.createDataFrame([("deadline", None), ("historical", "archive"), (None, None)], "r string, t string").select(T.retrieval_priority(F.col("r"), F.col("t"))).collect()
    assert [r[0] for r in rows] == [95, 20, 80]


words = st.lists(st.text("abcdefgh", min_size=1, max_size=12), min_size=1, max_size=80)


@settings(max_examples=60, deadline=None)
@given(words, st.integers(10, 60), st.integers(0, 9))
def test_chunks_lose_no_word(ws, size, overlap):
    text = " ".join(ws)
    found = chunks(text, size, overlap)
    assert set(text.split()) <= {w for c in found for w in c.split()} or any(len(w) > size for w in ws)
    if overlap == 0 and all(len(w) <= size for w in ws):
        assert " ".join(found).split() == ws


def test_chunks_overlap_and_reject_bad_sizes():
    found = chunks(" ".join(f"w{i:03d}" for i in range(100)), 50, 15)
    assert all(a.split()[-1] in b.split() for a, b in zip(found, found[1:], strict=False))
    assert chunks("  ") == []
    with pytest.raises(ValueError, match="smaller"):
        chunks("abc", 10, 10)


def test_small_sections_merge_forward_and_backward():
    path = ["Library", "Loans"]
    assert merged_sections([(["a"], "x" * 7), (["b"], "y" * 19), (path, "z" * 45)], 40) == [(path, "x" * 7 + "\n\n" + "y" * 19 + "\n\n" + "z" * 45)]
    assert merged_sections([(["a"], "x" * 53), (["b"], "y")], 40) == [(["a"], "x" * 53 + "\n\ny")]
    assert merged_sections([(["a"], "x"), (["b"], "y")], 40) == [(["b"], "x\n\ny")]


PAGE = """<html><head><title>T &amp; x</title><link rel="canonical" href="/c"><meta property="article:modified_time" content="2024-01-02T03:04:05Z"></head><body>
<a href="#main">Skip to main content</a><header>menu</header><div class="x sr-only">hidden</div><p>Intro with <a href="/z">a link</a>. More</p>
<h1>One</h1><p>para <b>bold</b> end .</p><h2><span>A</span> Holds</h2><ul><li>i1</li><li>i2</li></ul>
<table><tr><th>Reader</th><th>Loan period</th></tr><tr><td>Visiting readers</td><td>Two weeks</td></tr></table>
<table><tr><td>Desk 7</td><td>Free</td></tr></table><h1>Two</h1>tail<!-- c --></body></html>"""


def test_parse_page():
    page = parse_page(PAGE, "https://example.org/a")
    assert (page["title"], page["canonical_url"]) == ("T & x", "https://example.org/c")
    assert page["last_updated"].isoformat() == "2024-01-02T03:04:05+00:00"
    assert [(s["heading_path"], s["text"]) for s in page["sections"]] == [
        ([], "Intro with a link. More"), (["One"], "para bold end."),
        (["One", "A Holds"], "i1\ni2\n\nVisiting readers: Loan period: Two weeks\n\nDesk 7 | Free"), (["Two"], "tail"),
    ]
    assert "Skip" not in page["text"] and "menu" not in page["text"] and "hidden" not in page["text"]


def test_parse_page_falls_back():
    assert parse_page("<h1>Head</h1>", "")["title"] == "Head"
    assert parse_page("", "", "None")["title"] == "None"
    assert parse_page("<time datetime='bad'>x</time>", "")["last_updated"] is None
