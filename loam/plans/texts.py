"""Queries of the text, URL and metadata functions."""

from __future__ import annotations

import re
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal
from heapq import nsmallest
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.functions import text as T
from loam.operators.blocks import spread
from loam.plans.registry import query
from loam.sources.tables import table


def _sql_list(words: list[str] | tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _sql_any(text: str, markers: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{m}')" for m in markers) + ")"


def _sql_word(text: str, word: str) -> str:
    return f"regexp_matches({text}, '(^|[^a-z0-9_]){word}($|[^a-z0-9_])')"


def _sql_case(rules: list[tuple[str, str]], default: str) -> str:
    return "CASE " + " ".join(f"WHEN {condition} THEN {value}" for condition, value in rules) + f" ELSE {default} END"


CLEAN_SQL = (
    r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g'),"
    r" '\r\n?', chr(10), 'g'), '[ \t\x{{A0}}]+', ' ', 'g'), ' *\n *', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), ' +([.,;:!?])', '\1', 'g'), '^[ \n]+|[ \n]+$', '', 'g')"
)
TITLE_SQL = r"regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1)"
_RECODED_SQL = "replace(url_encode(url_decode(replace({0}, '+', ' '))), '%20', '+')"
NORM_SQL = f"""norm AS (SELECT page_id, url, rtrim(CASE WHEN q <> '' THEN path || '?' || q ELSE path END, '/') AS norm_url FROM (
  SELECT page_id, url, lower(regexp_replace(bare, '\\?.*$', '')) AS path,
    array_to_string(list_transform(list_filter(string_split(regexp_extract(bare, '\\?(.*)$', 1), '&'), lambda p: contains(p, '=') AND regexp_extract(p, '=(.*)$', 1) <> ''
      AND NOT list_contains({_sql_list(T.TRACKING_PARAMS)}, url_decode(replace(split_part(p, '=', 1), '+', ' ')))),
      lambda p: {_RECODED_SQL.format("split_part(p, '=', 1)")} || '=' || {_RECODED_SQL.format("regexp_extract(p, '=(.*)$', 1)")}), '&') AS q
  FROM (SELECT page_id, url, regexp_replace(url, '#.*$', '') AS bare FROM pages)))"""
TOKENS_SQL = "regexp_extract_all(lower({0}), '[a-z0-9]+')"
WORDS_SQL = r"list_filter(regexp_split_to_array({0}, '\s+'), lambda w: w <> '')"
SENTENCES_SQL = (
    r"list_filter(list_transform(flatten(list_transform(string_split(regexp_replace({0}, '[ \t]+', ' ', 'g'), chr(10)),"
    r" lambda line: string_split(regexp_replace(trim(line), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)))), lambda s: trim(s)), lambda s: s <> '')"
)
ANSWER_TERMS_SQL = "list_filter(list_distinct(" + TOKENS_SQL + "), lambda w: NOT list_contains(" + _sql_list(T.ANSWER_STOPWORDS) + ", w))"
CONTENT_WORDS_SQL = "list_filter(list_distinct(" + TOKENS_SQL + "), lambda w: length(w) >= 3 AND NOT list_contains(" + _sql_list(T.PHRASE_STOPWORDS) + ", w))"
GREETING_SQL = "(lower(trim({0})) IN (" + _sql_list(T.GREETINGS)[1:-1] + ") OR (len(" + WORDS_SQL.format("lower(trim({0}))") + ") <= 3 AND (" + " OR ".join(f"starts_with(lower(trim({{0}})), '{g}')" for g in T.GREETINGS) + ")))"
REPLY_SQL = _sql_case([(_sql_any("lower(trim({0}))", tuple(p.replace("'", "''") for p in phrases)), f"'{kind}'") for kind, phrases in T.REPLY_PHRASES], "NULL")


def title() -> Column:
    return F.regexp_extract("html", r"(?s)<title[^>]*>(.*?)</title>", 1)


@query("c1_url_normalize", f"WITH {NORM_SQL} SELECT page_id, norm_url FROM norm")
def url_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.normalize_url(F.col("url")).alias("norm_url"))


_URL_FLAGS = f"""SELECT page_id, {_sql_any('lower(url)', T.LOGIN_MARKERS)} AS is_login, contains(lower('Text/HTML; charset=' || page_id), 'text/html') AS is_html,
  regexp_matches(lower(url), '\\.({'|'.join(T.SKIP_EXTENSIONS)})$') AS is_skipped, {_sql_any(f'lower({TITLE_SQL})', T.ERROR_TITLES)} AS is_error_title,
  length(html) < 500 AS is_thin FROM pages"""


@query("c5_c9_page_predicates", _URL_FLAGS)
def page_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C5 login wall, C6 content type, C7 skipped extension, C8 soft 404, C9 thin page."""
    kind = F.concat(F.lit("Text/HTML; charset="), F.col("page_id").cast("string"))
    return table(spark, sf_dir, "pages").select(
        "page_id", T.is_login(F.col("url")).alias("is_login"), T.is_html(kind).alias("is_html"), T.has_skipped_extension(F.col("url")).alias("is_skipped"),
        T.is_error_title(title()).alias("is_error_title"), (F.length("html") < 500).alias("is_thin"),
    )


@query("t1_t7_t8_clean_hash_words", f"""SELECT doc_id, sha256(clean) AS content_hash, CAST(len({WORDS_SQL.format('clean')}) AS BIGINT) AS word_count,
  CAST(length(clean) AS BIGINT) AS clean_chars FROM (SELECT doc_id, {CLEAN_SQL.format("' a  b ' || chr(13) || chr(10) || chr(160) || text || ' ; ' || chr(7) || chr(10) || chr(10) || chr(10) || 'z .'")} AS clean FROM documents)""")
def clean_hash_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1 cleaning of texts with odd white space around them, T7 content hash, T8 word count."""
    odd = F.concat(F.lit(" a  b \r\n\u00a0"), "text", F.lit(" ; \x07\n\n\nz ."))
    clean = table(spark, sf_dir, "documents").select("doc_id", T.clean_text(odd).alias("clean"))
    return clean.select("doc_id", F.sha2("clean", 256).alias("content_hash"), T.word_count(F.col("clean")).alias("word_count"), F.length("clean").cast("long").alias("clean_chars"))


@query("t5_html_title", f"SELECT page_id, {TITLE_SQL} AS title FROM pages")
def html_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", title().alias("title"))


_TYPE_SQL = _sql_case(
    [(f"contains(lower(url), '{m}')", f"'{k}'") for m, k in T.URL_TYPES]
    + [(_sql_word(f"lower({TITLE_SQL})", w), f"'{k}'") for w, k in T.TITLE_TYPES]
    + [(f"length(html) - length(replace(html, '?', '')) >= {T.FAQ_MARKS} AND length(html) - length(replace(html, '?', '')) > {T.FAQ_DENSITY} * length(html)", "'faq'")],
    "'program_description'",
)


@query("t9_document_type", f"SELECT page_id, {_TYPE_SQL} AS document_type FROM pages")
def document_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.document_type(F.col("url"), title(), F.col("html")).alias("document_type"))


_AUDIENCE_SQL = _sql_case(
    [(f"contains(lower(url), '{m}')", _sql_list(x)) for m, x in T.URL_AUDIENCES] + [(f"contains(lower(department), '{m}')", _sql_list(x)) for m, x in T.DEPARTMENT_AUDIENCES],
    _sql_list(T.DEFAULT_AUDIENCE),
)
_DEPARTMENT_SQL = "CASE page_id % 5 WHEN 0 THEN 'Admissions Office' WHEN 1 THEN 'Career Services' WHEN 2 THEN 'Technology Services' WHEN 3 THEN 'Public Safety' ELSE 'Library' END"


@query("t10_audience", f"SELECT page_id, array_to_string({_AUDIENCE_SQL}, '|') AS audience FROM (SELECT page_id, url, {_DEPARTMENT_SQL} AS department FROM pages)")
def audience(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").withColumn("department", F.expr(_DEPARTMENT_SQL))
    return pages.select("page_id", F.array_join(T.audience(F.col("url"), F.col("department")), "|").alias("audience"))


_MENTION_SQL = "CASE page_id % 6 WHEN 0 THEN 'International' WHEN 1 THEN 'Undergraduate' WHEN 2 THEN 'Graduate school' WHEN 3 THEN 'First-year transfer' WHEN 4 THEN 'freshman' ELSE '' END"
_STUDENT_SQL = _sql_case([(_sql_word("lower(url || ' ' || title)", w), f"'{k}'") for w, k in T.STUDENT_KEYWORDS], "''")


@query("t11_student_types", f"SELECT page_id, {_STUDENT_SQL} AS student_types FROM (SELECT page_id, url, {_MENTION_SQL} AS title FROM pages)")
def student_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").withColumn("title", F.expr(_MENTION_SQL))
    return pages.select("page_id", F.array_join(T.student_types(F.col("url"), F.col("title")), "|").alias("student_types"))


@query("t13_t14_t17_token_sets", f"""SELECT doc_id, CAST(len({TOKENS_SQL.format('text')}) AS BIGINT) AS n_tokens, array_to_string(list_sort({ANSWER_TERMS_SQL.format('text')}), ' ') AS answer_terms,
  CAST(len({CONTENT_WORDS_SQL.format('text')}) AS BIGINT) AS n_content_words FROM documents""")
def token_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T13 tokens, T14 answer terms, T17 content words."""
    text = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.size(T.tokens(text)).cast("long").alias("n_tokens"), F.array_join(F.array_sort(T.answer_terms(text)), " ").alias("answer_terms"),
        F.size(T.content_words(text)).cast("long").alias("n_content_words"),
    )


_CLAIMS_SQL = r"list_filter(list_transform(string_split(regexp_replace(trim({0}), '([.!?])\s+([A-Z0-9\"''])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '')"


@query("t15_t16_sentences", f"SELECT doc_id, array_to_string({SENTENCES_SQL.format('text')}, '|') AS sentences, CAST(len({_CLAIMS_SQL.format('text')}) AS BIGINT) AS n_claims FROM documents")
def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T15 answer sentences, T16 claim sentences."""
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.array_join(T.sentences(F.col("text")), "|").alias("sentences"), F.size(T.claim_sentences(F.col("text"))).cast("long").alias("n_claims")
    )


_SAID_SQL = "CASE turn % 6 WHEN 0 THEN 'Hi there' WHEN 1 THEN 'history of art' WHEN 2 THEN 'I am a PhD student' WHEN 3 THEN 'First year!' WHEN 4 THEN 'compare both A and B' ELSE text END"


@query("t18_t19_t20_message_rules", f"""SELECT conv_id, turn, {GREETING_SQL.format('said')} AS is_greeting, {REPLY_SQL.format('said')} AS student_type,
  (contains(lower(said), 'both ') AND contains(lower(said), ' and ')) OR {_sql_any('lower(said)', T.COMPARISONS)} AS is_comparison
  FROM (SELECT conv_id, turn, {_SAID_SQL} AS said FROM conversations)""")
def message_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T18 greeting, T19 student-type reply, T20 comparison question."""
    said = F.col("said")
    turns = table(spark, sf_dir, "conversations").withColumn("said", F.expr(_SAID_SQL))
    return turns.select("conv_id", "turn", T.is_greeting(said).alias("is_greeting"), T.reply_student_type(said).alias("student_type"), T.is_comparison(said).alias("is_comparison"))


@query("t21_utc_attach", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') AS ts_utc FROM events")
def utc_attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Naive timestamps are UTC."""
    return table(spark, sf_dir, "events").select("event_id", F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00")).alias("ts_utc"))


_ID_SQL = f"""SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', CAST(('0x' || substr(h, 17, 1)) AS INTEGER) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS chunk_id
  FROM (SELECT doc_id, sha1(unhex('{T.CHUNK_NAMESPACE.replace('-', '')}') || encode(doc_id || ':0:' || doc_id % 3 || ':' || sha256(text))) AS h FROM documents)"""


@query("t22_chunk_ids", _ID_SQL)
def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.chunk_id(F.col("doc_id"), F.lit(0), F.col("doc_id") % 3, F.col("text")).alias("chunk_id"))


_ROLES = [*T.ROLE_PRIORITY]
_ROLE_SQL = _sql_case([(f"doc_id % {len(_ROLES) + 1} = {i}", f"'{r}'") for i, r in enumerate(_ROLES)], "NULL")
_TIME_SQL = "CASE doc_id % 5 WHEN 0 THEN 'historical' WHEN 1 THEN 'archive' WHEN 2 THEN 'current' END"
_PRIORITY_SQL = f"greatest(0, least(100, {_sql_case([(f'''role = '{r}' ''', str(v)) for r, v in T.ROLE_PRIORITY.items()], '80')} - CASE WHEN temporal IN ('historical', 'archive') THEN 40 ELSE 0 END))"
_SIZE_SQL = _sql_case([(f"role = '{r}'", str(4 * s)) for r, (s, _) in T.ROLE_TOKENS.items()], "1000")
_OVERLAP_SQL = _sql_case([(f"role = '{r}'", str(4 * o)) for r, (_, o) in T.ROLE_TOKENS.items()], "150")


@query("t23_t26_scores_and_sizes", f"""SELECT doc_id, authority, priority, round((1 - 0.1) + greatest(0.0, least(1.0, coalesce(CASE WHEN doc_id % 7 <> 0 THEN priority END, 50) / 100)) * 0.2, 6) AS multiplier, chunk_size, chunk_overlap
  FROM (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 8 ELSE 10 END AS authority, {_PRIORITY_SQL} AS priority, {_SIZE_SQL} AS chunk_size, {_OVERLAP_SQL} AS chunk_overlap
  FROM (SELECT doc_id, {_ROLE_SQL} AS role, {_TIME_SQL} AS temporal FROM documents))""")
def scores_and_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T23 authority score, T24 retrieval priority, T25 multiplier, T26 chunk size and overlap."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.expr(_ROLE_SQL).alias("role"), F.expr(_TIME_SQL).alias("temporal"))
    size, overlap = T.chunk_config(F.col("role"))
    priority = T.retrieval_priority(F.col("role"), F.col("temporal"))
    return docs.select(
        "doc_id", T.authority_score(F.col("doc_id") % 9 == 0).alias("authority"), priority.alias("priority"),
        F.round(T.priority_multiplier(F.when(F.col("doc_id") % 7 != 0, priority)), 6).alias("multiplier"), size.alias("chunk_size"), overlap.alias("chunk_overlap"),
    )


_PATH_SQL = "list_transform(range(1, CAST(doc_id % 4 AS INTEGER) + 1), lambda i: substr(text, 1, CAST(i * 70 AS INTEGER)))"
_FITS_SQL = "list_filter(list_transform(range(1, len(path) + 1), lambda i: array_to_string(path[i:], ' > ')), lambda s: length(s) <= 255)"


@query("t27_subtopic", f"SELECT doc_id, CASE WHEN len(path) > 0 THEN coalesce(({_FITS_SQL})[1], substr(path[-1], 1, 252) || '...') END AS subtopic FROM (SELECT doc_id, {_PATH_SQL} AS path FROM documents)")
def subtopics(spark: SparkSession, sf_dir: str) -> DataFrame:
    depth = (F.col("doc_id") % 4).cast("int")
    path = F.when(depth > 0, F.transform(F.sequence(F.lit(1), F.greatest(depth, F.lit(1))), lambda i: F.substring(F.col("text"), F.lit(1), i * 70))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf_dir, "documents").select("doc_id", path.alias("path")).select("doc_id", T.subtopic(F.col("path")).alias("subtopic"))


_REPLY_SQL = """CASE doc_id % 4 WHEN 0 THEN '{"answer": "a' || doc_id || '", "grounded": true, "citations_used": [1, 3], "sub_queries": [" x ", "", "y", "z", "w"]}'
  WHEN 1 THEN '{"sufficient": false, "reformulated_query": "q"}' WHEN 2 THEN 'not json' ELSE '{"answer": "b"}' END"""


@query("t28_json_envelopes", f"""SELECT doc_id, CASE WHEN ok THEN coalesce(json_extract_string(reply, '$.answer'), '') ELSE '' END AS answer,
  CASE WHEN ok THEN coalesce(CAST(json_extract(reply, '$.grounded') AS BOOLEAN), false) ELSE false END AS grounded,
  CASE WHEN ok THEN coalesce(array_to_string(CAST(json_extract(reply, '$.citations_used') AS BIGINT[]), ','), '') ELSE '' END AS citations,
  CASE WHEN ok THEN coalesce(CAST(json_extract(reply, '$.sufficient') AS BOOLEAN), true) ELSE true END AS sufficient,
  CASE WHEN ok THEN json_extract_string(reply, '$.reformulated_query') END AS reformulated,
  coalesce(array_to_string(list_filter(list_transform(CAST(CASE WHEN ok THEN json_extract(reply, '$.sub_queries') END AS VARCHAR[]), lambda s: trim(s)), lambda s: s <> '')[1:3], '|'), '') AS sub_queries
  FROM (SELECT doc_id, reply, json_valid(reply) AS ok FROM (SELECT doc_id, {_REPLY_SQL} AS reply FROM documents))""")
def json_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies in JSON, with defaults where they say nothing or aren't JSON."""
    schema = "answer string, grounded boolean, citations_used array<bigint>, sufficient boolean, reformulated_query string, sub_queries array<string>"
    said = table(spark, sf_dir, "documents").select("doc_id", F.from_json(F.expr(_REPLY_SQL), schema, {"mode": "PERMISSIVE"}).alias("r"))
    queries = F.slice(F.filter(F.transform("r.sub_queries", lambda s: F.trim(s)), lambda s: s != ""), 1, 3)
    return said.select(
        "doc_id", F.coalesce("r.answer", F.lit("")).alias("answer"), F.coalesce("r.grounded", F.lit(False)).alias("grounded"),
        F.coalesce(F.array_join("r.citations_used", ","), F.lit("")).alias("citations"), F.coalesce("r.sufficient", F.lit(True)).alias("sufficient"),
        F.col("r.reformulated_query").alias("reformulated"), F.coalesce(F.array_join(queries, "|"), F.lit("")).alias("sub_queries"),
    )


_PHRASES_SQL = r"""words AS (SELECT doc_id, c AS part, i AS pos, w, (list_contains({stop}, w) OR NOT regexp_matches(w, '^[a-z][a-z''-]*$')) AS stops FROM (
  SELECT doc_id, c, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT doc_id, c, list_filter(regexp_split_to_array(p, '\s+'), lambda x: x <> '') AS ws FROM (
    SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS c FROM (SELECT doc_id, regexp_split_to_array(lower(text), '[.!?,;:()\[\]{{}}"\n]+') AS ps FROM documents)))))"""
_RAKE_SQL = f"""WITH {_PHRASES_SQL.format(stop=_sql_list(T.PHRASE_STOPWORDS))},
runs AS (SELECT doc_id, part, pos, w, sum(CASE WHEN stops THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, part ORDER BY pos) AS run, stops FROM words),
phrases AS (SELECT doc_id, part, run, list(w ORDER BY pos) AS ws, min(pos) AS first_at, count(*) AS n FROM runs WHERE NOT stops GROUP BY doc_id, part, run),
scores AS (SELECT doc_id, w, sum(n) / count(*) AS score FROM (SELECT doc_id, n, unnest(ws) AS w FROM phrases) GROUP BY doc_id, w),
scored AS (SELECT p.doc_id, part, run, any_value(array_to_string(ws, ' ')) AS phrase, round(sum(s.score), 6) AS score, any_value(first_at) AS first_at FROM (SELECT *, unnest(ws) AS w FROM phrases WHERE n <= 4) p
  JOIN scores s ON s.doc_id = p.doc_id AND s.w = p.w GROUP BY p.doc_id, part, run),
best AS (SELECT doc_id, phrase, max(score) AS score, min(struct_pack(part := part, pos := first_at)) AS place FROM scored GROUP BY doc_id, phrase)
SELECT doc_id, rank, phrase, score FROM (SELECT doc_id, phrase, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, place) AS rank FROM best) WHERE rank <= 10"""


#: Words of a phrase that is scored, at most.
MAX_PHRASE = 4
_STOPS = frozenset(T.PHRASE_STOPWORDS)
_WORD = re.compile(r"[a-z][a-z'-]*\Z")


@query("t12_rake_keywords", _RAKE_SQL)
def rake_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best phrases of each document by word degree over frequency; phrases of over four words score words only."""
    return keywords(table(spark, sf_dir, "documents").select("doc_id", "text"))


def keywords(docs: DataFrame, count: int = 10) -> DataFrame:
    """doc_id, rank, phrase, score of the best phrases of docs(doc_id, text), a batch of documents at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [best_phrases(text or "", count) for text in batch.column("low").to_pylist()]
            owner = batch.column("doc_id").take(pa.array([i for i, x in enumerate(found) for _ in x], pa.int64()))
            ranks, phrases, scores = ([y for x in found for y in column(x)] for column in (lambda x: range(1, len(x) + 1), lambda x: [p for p, _ in x], lambda x: [v for _, v in x]))
            yield pa.RecordBatch.from_arrays([owner, pa.array(ranks, pa.int64()), pa.array(phrases, pa.string()), pa.array(scores, pa.float64())], names)

    schema = docs.select("doc_id").schema.add("rank", "long").add("phrase", "string").add("score", "double")
    names = schema.names
    return spread(docs.select("doc_id", "text")).select("doc_id", F.lower("text").alias("low")).mapInArrow(run, schema)


def best_phrases(text: str, count: int) -> list[tuple[str, float]]:
    """The best phrases of a text in lower case with their scores: runs of words between stop words and punctuation.

    A word scores the mean number of words of the phrases that it is in; a phrase of up to MAX_PHRASE words the sum of
    its words' scores. Ties go to the phrase that comes first.
    """
    phrases = []
    for part in re.split(r"[.!?,;:()\[\]{}\"\n]+", text):
        for stop, run in groupby(re.split(r"[ \t\n\x0b\f\r]+", part), lambda w: w == "" or w in _STOPS or not _WORD.match(w)):
            if not stop:
                phrases.append(tuple(run))
    sizes: dict[str, list[int]] = {}
    for phrase in phrases:
        for w in phrase:
            sizes.setdefault(w, []).append(len(phrase))
    scores = {w: sum(x) / len(x) for w, x in sizes.items()}
    first = {phrase: at for at, phrase in reversed(list(enumerate(phrases))) if len(phrase) <= MAX_PHRASE}
    rated = ((float(Decimal(repr(sum(scores[w] for w in p))).quantize(Decimal("0.000001"), ROUND_HALF_UP)), at, p) for p, at in first.items())
    return [(" ".join(p), score) for score, _, p in nsmallest(count, rated, key=lambda x: (-x[0], x[1]))]
