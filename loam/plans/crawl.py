"""Queries of crawling, sources and chunking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.functions import text as T
from loam.functions.chunk import chunk_documents
from loam.functions.html import parse_pages
from loam.operators import crawl as C
from loam.plans.registry import query
from loam.plans.texts import NORM_SQL, TITLE_SQL, _sql_any, title
from loam.sources.tables import FEEDBACK_SQL, feedback, table

_INSIDE_SQL = r"""(?:[^>"'']|"[^"]*"|''[^'']*''|["''])*"""
_RAW_SQL = "|".join(rf"<{name}\b{_INSIDE_SQL}(?:>.*?(?:</{name}\b|\z)|\z)" for name in ("script", "style", "textarea", "title", "template"))
_PAIRS_SQL = r"""'(?is)([^\s"''>/=]+)(?:\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>][^\s>]*))?'"""
_NAMES_SQL = "list_transform(names, lambda n : lower(n))"
_LINKS_SQL = rf"""tags AS (SELECT url, unnest(regexp_extract_all(html, '(?is)<!--.*?(?:-->|\z)|{_RAW_SQL}|<a([\s/]{_INSIDE_SQL})(?:>|\z)', 1)) AS tag FROM source),
pairs AS (SELECT url, regexp_extract_all(tag, {_PAIRS_SQL}, 1) AS names, regexp_extract_all(tag, {_PAIRS_SQL}, 2) AS vals FROM tags),
found AS (SELECT url, trim(replace(regexp_replace(coalesce(vals[list_position({_NAMES_SQL}, 'href')], ''), '^["'']|["'']$', '', 'g'), '&amp;', '&')) AS href FROM pairs WHERE list_contains({_NAMES_SQL}, 'href')),
kept AS (SELECT url, href, regexp_replace(regexp_replace(url, '[?#].*$', ''), '(^https?://[^/]+/.*/|^https?://[^/]+/?)[^/]*$', '\1') AS folder FROM found WHERE NOT regexp_matches(href, '^(mailto:|tel:|javascript:|#)')),
joined AS (SELECT url AS page, CASE WHEN regexp_matches(href, '^https?://') THEN href WHEN starts_with(href, '//') THEN regexp_extract(url, '^(https?:)', 1) || href
  WHEN starts_with(href, '/') THEN regexp_extract(url, '^(https?://[^/?#]+)', 1) || href WHEN starts_with(href, '?') THEN regexp_replace(url, '[?#].*$', '') || href WHEN href = '' THEN url
  ELSE CASE WHEN ends_with(folder, '/') THEN folder ELSE folder || '/' END || href END AS url FROM kept),
absolute AS (SELECT page, regexp_replace(regexp_replace(url, '^(https?://[^/?#]+(?:/[^/?#]+)*?)/[^/?#]+/\.\./', '\1/'), '^(https?://[^/?#]+)/\.\./', '\1/') AS url FROM joined)"""
_LINKED_SQL = f"{_LINKS_SQL}, {NORM_SQL.replace('FROM pages', 'FROM (SELECT page AS page_id, url FROM absolute)')} SELECT DISTINCT page_id AS url, norm_url AS link FROM norm"


@query("c3_link_extraction", f"WITH source AS (SELECT url, html FROM pages), {_LINKED_SQL}")
def link_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.links(table(spark, sf_dir, "pages"))


#: Markup that each page is given: live anchors in every kind of quotes, and dead ones in comments, scripts and other attributes.
_FORMS = """<A class='x>y' HREF = '../up/{i}?a=1&amp;b=2'>1</A><a title="a > b" href=bare/{i}>2</a><a data-href="/data" name=z>3</a><a href>4</a><a/href="/slash/{i}">5</a>
<!-- <a href="/comment/{i}"> -- > --><script type="a>b">var s = "<a href='/script/{i}'>" + "<!--";</script><textarea><a href="/text"></textarea><abbr href="/abbr">6</abbr>
<a href="//other.example.org/{i}/">7</a><a href="mailto:x@y.z">8</a><a id="q'" href='quote{i}'>9</a><a href=/last/{i} title="never closed"""
_FORMS_SQL = "'" + _FORMS.replace("'", "''") + "'"


@query("c3_link_forms", f"WITH source AS (SELECT url, html || replace({_FORMS_SQL}, '{{i}}', CAST(page_id AS VARCHAR)) AS html FROM pages), {_LINKED_SQL}")
def link_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C3 on the pages with markup after their own: quotes of every kind, references, dots, comments, scripts, an open tag."""
    more = F.replace(F.lit(_FORMS), F.lit("{i}"), F.col("page_id").cast("string"))
    return C.links(table(spark, sf_dir, "pages").select("url", F.concat("html", more).alias("html")))


_RULES_SQL = "rules AS (SELECT DISTINCT lower(regexp_extract(url, '^(https?://[^/?#]+)', 1)) AS origin, '/en' AS prefix FROM pages WHERE page_id % 3 = 0)"


@query("c4_robots_filter", f"WITH {_RULES_SQL} SELECT page_id, url FROM pages p WHERE NOT EXISTS (SELECT 1 FROM rules WHERE origin = lower(regexp_extract(p.url, '^(https?://[^/?#]+)', 1)) AND starts_with(regexp_replace(p.url, '^https?://[^/?#]+', ''), prefix))")
def robots_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C4 with rules for every third page's origin, which disallow English pages."""
    pages = table(spark, sf_dir, "pages")
    rules = pages.filter("page_id % 3 = 0").select(C.origin(F.col("url")).alias("origin"), F.lit("/en").alias("prefix")).distinct()
    return C.allowed(pages.select("page_id", "url"), rules)


@query("c10_exact_dedup", "SELECT doc_id, first_value(doc_id) OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS survivor, CASE WHEN row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) = 1 THEN 'accepted' ELSE 'duplicate' END AS status FROM documents")
def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), F.col("doc_id").alias("url"), F.sha2("text", 256).alias("hash"))
    found = C.first_of(docs, F.col("hash"))
    return found.select(F.col("url").alias("doc_id"), "survivor", F.when(F.col("survivor") == F.col("url"), "accepted").otherwise("duplicate").alias("status"))


@query("c11_url_dedup", f"WITH {NORM_SQL} SELECT page_id, first_value(page_id) OVER (PARTITION BY norm_url ORDER BY page_id) AS survivor FROM norm")
def url_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("seq"), F.col("page_id").alias("url"), T.normalize_url(F.col("url")).alias("norm"))
    return C.first_of(pages, F.col("norm")).select(F.col("url").alias("page_id"), "survivor")


@query("c12_j9_manifest_anti_join", f"WITH {NORM_SQL} SELECT page_id FROM norm WHERE norm_url NOT IN (SELECT norm_url FROM norm WHERE page_id % 4 = 0) AND url NOT IN (SELECT url FROM norm WHERE page_id % 5 = 0)")
def manifest_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose normalised and own URLs are both unknown to the manifest."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", T.normalize_url(F.col("url")).alias("norm_url"))
    return pages.join(pages.filter("page_id % 4 = 0").select("norm_url"), "norm_url", "left_anti").join(pages.filter("page_id % 5 = 0").select("url"), "url", "left_anti").select("page_id")


# Canonical and content groups that chain: page 2n is canonical with 2n + 1, content joins page n and n + 3 in some places.
_STAGED_SQL = f"""staged AS (SELECT page_id AS seq, url, CAST(page_id // 2 AS VARCHAR) AS canonical, sha256(CAST(CASE WHEN page_id % 6 IN (1, 4) THEN page_id // 6 ELSE -page_id END AS VARCHAR)) AS content_hash,
  page_id % 10 = 0 AS in_manifest, {_sql_any(f'lower({TITLE_SQL})', T.ERROR_TITLES)} AS is_error, length(html) < 1500 AS is_thin, page_id % 9 = 0 AS unclassifiable FROM pages)"""
CASCADE_SQL = f"""WITH RECURSIVE {_STAGED_SQL}, numbered AS (SELECT *, row_number() OVER (ORDER BY seq) AS n FROM staged),
walk AS (SELECT CAST(0 AS BIGINT) AS n, CAST('' AS VARCHAR) AS url, CAST(NULL AS VARCHAR) AS reason, CAST([] AS VARCHAR[]) AS cs, CAST([] AS VARCHAR[]) AS hs, CAST([] AS VARCHAR[]) AS us
  UNION ALL SELECT n, url, reason, CASE WHEN reason IS NULL THEN list_append(cs, canonical) ELSE cs END, CASE WHEN reason IS NULL THEN list_append(hs, content_hash) ELSE hs END, CASE WHEN reason IS NULL THEN list_append(us, url) ELSE us END
  FROM (SELECT p.n, p.url, p.canonical, p.content_hash, w.cs, w.hs, w.us, CASE WHEN in_manifest THEN 'already in manifest' WHEN is_error THEN 'error page' WHEN is_thin THEN 'thin content'
    WHEN list_contains(w.cs, canonical) THEN 'duplicate canonical: ' || us[list_position(w.cs, canonical)] WHEN list_contains(w.hs, content_hash) THEN 'duplicate content of ' || us[list_position(w.hs, content_hash)]
    WHEN unclassifiable THEN 'unclassifiable' END AS reason FROM walk w JOIN numbered p ON p.n = w.n + 1)),
decided AS (SELECT url, CASE WHEN reason IS NULL THEN 'accepted' ELSE 'rejected' END AS status, reason FROM walk WHERE n > 0)"""


def _staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("page_id")
    content = F.when((i % 6).isin(1, 4), F.floor(i / 6)).otherwise(-i)
    return table(spark, sf_dir, "pages").select(
        i.alias("seq"), "url", F.floor(i / 2).cast("string").alias("canonical"), F.sha2(content.cast("string"), 256).alias("content_hash"), (i % 10 == 0).alias("in_manifest"),
        T.is_error_title(title()).alias("is_error"), (F.length("html") < 1500).alias("is_thin"), (i % 9 == 0).alias("unclassifiable"),
    )


@query("c13_reject_cascade", f"{CASCADE_SQL} SELECT url, status, reason FROM decided")
def reject_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.cascade(_staged(spark, sf_dir))


@query("c15_reason_histogram", f"{CASCADE_SQL} SELECT split_part(split_part(reason, ' (', 1), ':', 1) AS reason, count(*) AS n FROM decided WHERE status = 'rejected' GROUP BY 1")
def reason_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.reason_counts(C.cascade(_staged(spark, sf_dir)))


@query("c14_j15_bounded_search", """WITH RECURSIVE edges AS (SELECT page_id AS source, (page_id * 7 + k * 13 + 1) % (SELECT count(*) FROM pages) AS target FROM pages, (SELECT unnest([0, 1, 2]) AS k)),
bfs AS (SELECT page_id AS seed, page_id AS node, 0 AS depth FROM pages WHERE page_id % 50 = 0 UNION SELECT seed, target, depth + 1 FROM bfs JOIN edges ON source = node WHERE depth < 3),
best AS (SELECT seed, node, min(depth) AS depth FROM bfs GROUP BY ALL) SELECT seed, node, depth FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY depth, node) AS n FROM best) WHERE n <= 25""")
def bounded_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C14, J15 on a stand-in link graph with three links a page and a seed for every fiftieth page."""
    pages = table(spark, sf_dir, "pages").select("page_id")
    total = pages.agg(F.count("*").alias("total"))
    k = F.explode(F.array(*map(F.lit, range(3)))).alias("k")
    edges = pages.select("page_id", k).crossJoin(F.broadcast(total)).select(F.col("page_id").alias("source"), ((F.col("page_id") * 7 + F.col("k") * 13 + 1) % F.col("total")).alias("target"))
    return C.bounded_search(pages.filter("page_id % 50 = 0").select(F.col("page_id").alias("seed")), edges, 3, 25)


@query("s1_source_manifest", "SELECT DISTINCT source AS department, lang AS topic, 'https://' || source || '.example.org/' || lang AS url FROM documents")
def source_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of the fixture, one source for each department and topic."""
    url = F.concat(F.lit("https://"), "source", F.lit(".example.org/"), "lang")
    return table(spark, sf_dir, "documents").select(F.col("source").alias("department"), F.col("lang").alias("topic"), url.alias("url")).distinct()


@query("s2_crawl_seeds", "SELECT lower(regexp_extract(url, '^(https?://[^/?#]+)', 1)) AS start_url, 2 AS max_depth, 25 AS max_pages, count(*) AS pages FROM pages GROUP BY 1")
def crawl_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").groupBy(C.origin(F.col("url")).alias("start_url")).agg(F.count("*").alias("pages"))
    return pages.select("start_url", F.lit(2).alias("max_depth"), F.lit(25).alias("max_pages"), "pages")


@query("s3_fetch_outcomes", "SELECT page_id, CASE WHEN page_id % 20 = 0 THEN 'failed' WHEN page_id % 33 = 0 THEN 'not modified' ELSE 'fetched' END AS outcome FROM pages")
def fetch_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3 over stored responses: errors fail, 304 is a success without content."""
    status = F.when(F.col("page_id") % 20 == 0, 404).when(F.col("page_id") % 33 == 0, 304).otherwise(200)
    outcome = F.when(F.col("status") == 304, "not modified").when(F.col("status").between(200, 299), "fetched").otherwise("failed")
    return table(spark, sf_dir, "pages").select("page_id", status.alias("status")).select("page_id", outcome.alias("outcome"))


@query("s4_t2_t6_c2_parsed_pages")
def parsed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title, text, sections, canonical link and time of every page."""
    return parse_pages(table(spark, sf_dir, "pages")).select("url", "title", "text", F.size("sections").alias("n_sections"), "canonical_url", "last_updated")


_HOURS_SQL = """'[{"unit_name": "Unit ' || page_id || '", "street_address": "1 Main St", "city": "Town", "state": null, "phone_number": "555", "calendar": {"nextSevenDays": [{"day": "Today", "date": "d0", "hours": ' ||
  CASE WHEN page_id % 2 = 0 THEN '[{"label": "8-5"}, {"label": "6-7"}]' ELSE '[]' END || '}, {"day": "Tue", "date": "d1", "hours": [{"label": "9-5"}]}, {"day": "Wed", "date": "d2", "hours": null}]}}]'"""


@query("s6_library_hours", """SELECT page_id, 'Unit ' || page_id || ' hours for the next seven days:' || chr(10) || CASE WHEN page_id % 2 = 0 THEN 'Unit ' || page_id || ' is open right now and today''s hours (d0) are 8-5; 6-7.'
  ELSE 'Unit ' || page_id || ' is closed right now, with no hours open today (d0).' END || chr(10) || 'Unit ' || page_id || ' hours on Tue (d1): open 9-5' || chr(10) || 'Unit ' || page_id || ' hours on Wed (d2): closed all day' || chr(10) ||
  'Address: 1 Main St, Town' || chr(10) || 'Phone: 555' AS text FROM pages""")
def library_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loam.sources.files import opening_hours

    return table(spark, sf_dir, "pages").select("page_id", opening_hours(F.expr(_HOURS_SQL)).alias("text"))


@query("s11_manifest_markdown", """SELECT lang AS topic, '## ' || lang || ' (' || count(*) || ' sources)' || chr(10) || string_agg('- ' || source || ': ' || n, chr(10) ORDER BY source) AS section FROM (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL) GROUP BY lang""")
def manifest_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loam.sources.files import markdown_sections

    counts = table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("topic"), F.col("source").alias("department")).agg(F.count("*").alias("n"))
    return markdown_sections(counts)


def _sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in sections: each line a section, with its number as heading."""
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct(F.array(F.concat(F.lit("Part "), i.cast("string"))).alias("heading_path"), x.alias("text")))
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("document_id"), "text", F.when(F.col("doc_id") % 3 != 0, lines).alias("sections"), F.lit(T.CHUNK_SIZE).alias("chunk_size"), F.lit(T.CHUNK_OVERLAP).alias("chunk_overlap"))


@query("k1_k7_chunk_documents")
def chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1-K7 with K8 numbers, T22 ids and T27 subtopics; a third of the documents have no sections."""
    from loam.operators.ingest import numbered

    found = numbered(chunk_documents(_sections(spark, sf_dir)))
    ids = T.chunk_id(F.col("document_id"), F.col("section_index"), F.col("local_index"), F.col("content"))
    return found.select("document_id", "chunk_number", "section_index", "local_index", T.subtopic(F.col("heading_path")).alias("subtopic"), ids.alias("chunk_id"), "content", "parent_text")


@query("r12_hashed_embeddings", """WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents), d AS (SELECT doc_id, CAST(('0x' || substr(md5(w), 1, 2)) AS INTEGER) % 64 AS dim, CASE WHEN substr(md5(w), 3, 1) < '8' THEN 1 ELSE -1 END AS s FROM t),
v AS (SELECT doc_id, dim, sum(s) AS x FROM d GROUP BY ALL), n AS (SELECT doc_id, sqrt(sum(x * x)) AS norm FROM v GROUP BY 1) SELECT doc_id, dim, round(x / norm, 6) AS x FROM v JOIN n USING (doc_id) WHERE x <> 0""")
def hashed_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deterministic stand-in for a text model, as (document, dimension, value)."""
    from loam.models import hashed_vectors

    return hashed_vectors(table(spark, sf_dir, "documents").select(F.col("doc_id"), "text"), "doc_id", 64)


@query("n10_two_pass_retrieval", """WITH q AS (SELECT item_id, text, length(text) % 3 = 0 AS sufficient FROM benchmark) SELECT item_id, 1 AS attempt, text AS asked FROM q WHERE sufficient
UNION ALL SELECT item_id, 2, array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+')[1:5], ' ') FROM q WHERE NOT sufficient""")
def two_pass_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N9, N10 unrolled: questions judged insufficient are asked again, reformulated, at most once."""
    from loam.models import two_passes

    items = table(spark, sf_dir, "benchmark").select("item_id", "text")
    return two_passes(items, F.length("text") % 3 == 0, F.array_join(F.slice(T.tokens(F.col("text")), 1, 5), " "))


_RATES_SQL = "round(avg(CASE WHEN low >= {0} THEN 1.0 ELSE 0.0 END), 6) AS grounded, round(avg(CASE WHEN high >= {0} THEN 1.0 ELSE 0.0 END), 6) AS sufficient, round(avg(CASE WHEN rating = 'helpful' THEN 1.0 ELSE 0.0 END), 6) AS precision"


@query("e12_e13_tuning_audit", f"""WITH {FEEDBACK_SQL}, scored AS (SELECT rating, list_min(scores) AS low, list_max(scores) AS high FROM feedback), n AS (SELECT count(*) AS eligible,
  count(*) FILTER (rating = 'not_helpful' AND low < 1.0 + 1.0) / nullif(count(*), 0) AS rate FROM scored WHERE low IS NOT NULL),
d AS (SELECT CASE WHEN eligible < 20 THEN 'insufficient_samples' WHEN rate < 0.15 THEN 'no_signal' ELSE 'candidate' END AS decision, CASE WHEN eligible >= 20 AND rate >= 0.15 THEN 1.25 END AS new_value FROM n),
g0 AS (SELECT {_RATES_SQL.format('0.0')} FROM scored), g1 AS (SELECT {_RATES_SQL.format('1.0')} FROM scored), g2 AS (SELECT {_RATES_SQL.format('(SELECT coalesce(new_value, 1.0) FROM d)')} FROM scored),
steady AS (SELECT 'steady' AS run, decision, 1.0 AS old_value, new_value, new_value IS NOT NULL AS applied, g0.grounded AS gb, g0.grounded AS ga, g0.sufficient AS sb, g0.sufficient AS sa, g0.precision AS pb, g0.precision AS pa FROM d, g0),
strict AS (SELECT 'strict' AS run, decision, 1.0 AS old_value, new_value, new_value IS NOT NULL AND NOT (g2.grounded < g1.grounded OR g2.sufficient < g1.sufficient OR g2.precision < g1.precision - 0.01) AS applied,
  g1.grounded AS gb, g2.grounded AS ga, g1.sufficient AS sb, g2.sufficient AS sa, g1.precision AS pb, g2.precision AS pa FROM d, g1, g2),
audit AS (SELECT * FROM steady UNION ALL SELECT * FROM strict)
SELECT run, decision, old_value, new_value, applied, gb AS grounded_rate_before, ga AS grounded_rate_after, sb AS citation_sufficiency_rate_before, sa AS citation_sufficiency_rate_after, pb AS context_precision_before, pa AS context_precision_after FROM audit
UNION ALL SELECT run, 'reverted', new_value, old_value, true, ga, gb, sa, sb, pa, pb FROM audit WHERE applied""")
def tuning_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run whose gate holds, so that its candidate is applied and then reverted; and one whose rates a higher floor lowers."""
    from loam.operators.tune import reverted, tuned

    rows = feedback(spark, sf_dir)
    scores = F.filter(F.transform("citations", lambda c: c["rerank_score"]), lambda s: s.isNotNull())
    rate = lambda x: F.round(F.avg(F.when(x, 1.0).otherwise(0.0)), 6)

    def gate(floor: float) -> DataFrame:
        return rows.agg(
            rate(F.array_min(scores) >= floor).alias("grounded_rate"), rate(F.array_max(scores) >= floor).alias("citation_sufficiency_rate"),
            rate(F.col("rating") == "helpful").alias("context_precision"),
        )

    runs = {"steady": tuned(rows, 1.0, lambda _: gate(0.0)), "strict": tuned(rows, 1.0, gate)}
    named = [part.select(F.lit(name).alias("run"), "*") for name, run in runs.items() for part in (run, reverted(run))]
    return named[0].unionByName(named[1]).unionByName(named[2]).unionByName(named[3])
