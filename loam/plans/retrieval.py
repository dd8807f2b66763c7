"""Queries of filters, rankers, fusion, relaxation, reranking and classification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.functions import text as T
from loam.operators import embed as M
from loam.operators import lexical as L
from loam.operators import retrieval as R
from loam.operators import vectors as V
from loam.operators.blocks import broadcast_if_small, kept
from loam.operators.nearest import classify, nearest, nearest_in_cells
from loam.operators.store import built, fingerprint
from loam.plans.registry import query
from loam.plans.texts import TOKENS_SQL
from loam.sources.tables import CORPUS_SQL, corpus, table

QUERY_TEXT = "the and of to in that this with was for"
PRIORITY_SQL = "((1 - 0.1) + greatest(0.0, least(1.0, coalesce(retrieval_priority, 50) / 100)) * (2 * 0.1))"


def bm25_sql(docs: str, queries: str, out: str) -> str:
    """CTEs that score queries(query_id, text) on docs(chunk_id, content) into out(query_id, chunk_id, score)."""
    return f"""{out}_dl AS (SELECT chunk_id, {TOKENS_SQL.format('content')} AS ts FROM {docs}),
{out}_tf AS (SELECT chunk_id, dl, term, count(*) AS tf FROM (SELECT chunk_id, len(ts) AS dl, unnest(ts) AS term FROM {out}_dl) GROUP BY ALL),
{out}_n AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM {out}_dl),
{out}_raw AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS idf, avgdl FROM {out}_tf, {out}_n GROUP BY term, n, avgdl),
{out}_idf AS (SELECT term, avgdl, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM {out}_raw) ELSE idf END AS idf FROM {out}_raw),
{out}_q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({TOKENS_SQL.format('text')}) AS term FROM {queries}) GROUP BY ALL),
{out} AS (SELECT * FROM (SELECT query_id, chunk_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS score
  FROM {out}_q JOIN {out}_idf USING (term) JOIN {out}_tf USING (term) GROUP BY ALL) WHERE score > 0)"""


def top_sql(source: str, by: str, score: str, tie: str, k: int, columns: str = "*") -> str:
    return f"SELECT {columns} FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {score} DESC, {tie}) AS rank FROM {source}) WHERE rank <= {k}"


COSINE_SQL = "round(list_cosine_similarity({0}::DOUBLE[], {1}::DOUBLE[]), 6)"
_FILTER_SQL = "index_status = 'approved' AND topic = 'en' AND (len(student_types) = 0 OR list_contains(student_types, 'graduate')) AND (len(audience) = 0 OR list_contains(audience, 'current_student'))"


@query("f1_f6_retrieval_filters", f"""WITH {CORPUS_SQL} SELECT chunk_id, {_FILTER_SQL} AND coalesce(document_type = 'policy', false) AS lexical,
  {_FILTER_SQL} AND (document_type IS NULL OR document_type = 'policy') AND vec_id IS NOT NULL AS semantic FROM corpus LEFT JOIN embeddings ON vec_id = chunk_id""")
def retrieval_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 status, F2 topic, F3 student type, F4 audience, F5 document type by ranker, F6 has a vector."""
    asked = {"topic": F.lit("en"), "student_type": F.lit("graduate"), "audience": F.lit("current_student"), "document_type": F.lit("policy")}
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    rows = corpus(spark, sf_dir).join(vectors, "chunk_id", "left")
    return rows.select("chunk_id", F.coalesce(R.passes(**asked), F.lit(False)).alias("lexical"), (R.passes(**asked, null_type=True) & F.col("embedding").isNotNull()).alias("semantic"))


def index(spark: SparkSession, sf_dir: str) -> L.Index:
    """The stored index of the corpus, built by the first query that asks for it in this state of the documents."""
    key = fingerprint(spark, f"{sf_dir}/documents.parquet")
    return L.opened(spark, built(spark, "bm25", key, lambda path: L.build(corpus(spark, sf_dir), path)))


def _within(queries: DataFrame, scope: Column) -> DataFrame:
    """queries with the scope that they search and take their statistics from."""
    return queries.withColumn("scope", scope).withColumn("statistics", F.col("scope"))


def _one_query(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.lit(0).cast("long").alias("query_id"), F.lit(QUERY_TEXT).alias("text"))


_APPROVED_SQL = "ok AS (SELECT chunk_id, content FROM corpus WHERE index_status = 'approved' AND topic = 'en')"
_ONE_SQL = f"q AS (SELECT CAST(0 AS BIGINT) AS query_id, '{QUERY_TEXT}' AS text)"


@query("r1_bm25_topk", f"WITH {CORPUS_SQL}, {_APPROVED_SQL}, {_ONE_SQL}, {bm25_sql('ok', 'q', 's')} {top_sql('s', 'query_id', 'score', 'chunk_id', 20, 'chunk_id, score, rank')}")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R1 BM25 on the filtered corpus, F7 positive scores, W2 top 20."""
    return L.search(index(spark, sf_dir), _within(_one_query(spark), L.scope(topic=F.lit("en"))), 20).select("chunk_id", "score", "rank")


_ITEMS_SQL = "items AS (SELECT item_id AS query_id, text FROM benchmark)"
_ALL_SQL = "docs AS (SELECT doc_id AS chunk_id, text AS content FROM documents)"
BATCH_SQL = f"{_ITEMS_SQL}, {_ALL_SQL}, {bm25_sql('docs', 'items', 's')}, ranked AS ({top_sql('s', 'query_id', 'score', 'chunk_id', 20)})"


def batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, chunk_id, score, rank): the 20 best documents of every benchmark item."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return kept(L.search(index(spark, sf_dir), _within(items, F.lit(L.EVERYTHING)), 20))


@query("r1_bm25_batch_topk", f"WITH {BATCH_SQL} SELECT query_id AS item_id, chunk_id AS doc_id, score, rank FROM ranked")
def bm25_batch_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch(spark, sf_dir).select(F.col("query_id").alias("item_id"), F.col("chunk_id").alias("doc_id"), "score", "rank")


_VECTORS_SQL = "(SELECT q.vec_id AS query_id, v.vec_id, " + COSINE_SQL.format("q.embedding", "v.embedding") + " AS sim FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0)"


@query("r2_vector_topk", top_sql(_VECTORS_SQL, "query_id", "sim", "vec_id", 20, "query_id, vec_id, sim, rank"))
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact cosine top 20 of a stated set of queries, every fiftieth vector."""
    vectors = table(spark, sf_dir, "embeddings")
    queries = vectors.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    found = nearest(vectors.filter("embedding IS NOT NULL").select(F.col("vec_id").alias("chunk_id"), "embedding"), queries, 20)
    return found.select("query_id", F.col("chunk_id").alias("vec_id"), F.col("score").alias("sim"), "rank")


@query("r3_vector_topk_pruned", top_sql(_VECTORS_SQL, "query_id", "sim", "vec_id", 20, "query_id, vec_id, sim, rank"))
def vector_topk_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by a sign-bit index: the query's own cell, then each cell that can hold a nearer vector; exact."""
    bits, k = 3, 20
    vectors = R.lsh_codes(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding"), bits)
    asked = vectors.filter("chunk_id % 50 = 0").withColumnRenamed("chunk_id", "query_id")
    return nearest_in_cells(vectors, asked, k, lambda queries: R.lsh_bounds(queries, bits)).select("query_id", F.col("chunk_id").alias("vec_id"), F.col("score").alias("sim"), "rank")


def vector_index(spark: SparkSession, sf_dir: str) -> V.Index:
    key = fingerprint(spark, f"{sf_dir}/embeddings.parquet")
    return V.opened(spark, built(spark, "vectors", key, lambda path: V.build(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), path)))


@query("r3_vector_index")
def vector_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every fiftieth vector by the stored index; approximate, so without SQL."""
    queries = table(spark, sf_dir, "embeddings").filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return V.search(vector_index(spark, sf_dir), queries, 20)


_COVERED_SQL = f"len(list_intersect(list_distinct({TOKENS_SQL.format('i.text')}), list_distinct({TOKENS_SQL.format('content')}))) / len(list_distinct({TOKENS_SQL.format('i.text')}))"
_FEEDBACK_SQL = f"""WITH {_ITEMS_SQL}, {_ALL_SQL}, {bm25_sql('docs', 'items', 's')}, ranked AS MATERIALIZED ({top_sql('s', 'query_id', 'score', 'chunk_id', 10)}),
short AS (SELECT r.query_id FROM ranked r JOIN items i USING (query_id) JOIN docs USING (chunk_id) WHERE rank = 1 AND {_COVERED_SQL} < {L.ENOUGH}),
shared AS (SELECT r.query_id, r.chunk_id, i.text, unnest({TOKENS_SQL.format('content')}) AS term FROM ranked r JOIN short USING (query_id) JOIN items i USING (query_id) JOIN docs USING (chunk_id) WHERE rank <= {L.FEEDBACK_CHUNKS}),
counted AS (SELECT query_id, text, term, count(DISTINCT chunk_id) AS n, count(*) AS tf FROM shared WHERE NOT list_contains({TOKENS_SQL.format('text')}, term) GROUP BY ALL),
again AS MATERIALIZED (SELECT query_id, text || ' ' || string_agg(term, ' ') AS text FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, tf DESC, term) AS place FROM counted) WHERE place <= {L.FEEDBACK_WORDS} GROUP BY query_id, text),
{bm25_sql('docs', 'again', 'z')}, second AS ({top_sql('z', 'query_id', 'score', 'chunk_id', 10)})
SELECT query_id AS item_id, 1 AS attempt, chunk_id AS doc_id, score, rank FROM ranked WHERE query_id NOT IN (SELECT query_id FROM again) UNION ALL SELECT query_id, 2, chunk_id, score, rank FROM second"""


@query("n10_relevance_feedback", _FEEDBACK_SQL)
def relevance_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items whose best document lacks a quarter of their words are searched again, with words of their best documents."""
    items = _within(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text"), F.lit(L.EVERYTHING))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))
    found = L.two_passes(index(spark, sf_dir), items, docs, 10)
    return found.select(F.col("query_id").alias("item_id"), "attempt", F.col("chunk_id").alias("doc_id"), "score", "rank")


def embedder(spark: SparkSession, sf_dir: str) -> tuple[M.Embedder, DataFrame]:
    """The embedder of the documents, and their vectors (chunk_id, embedding)."""
    key = fingerprint(spark, f"{sf_dir}/documents.parquet")
    return M.opened(spark, built(spark, "embedder", key, lambda path: M.build(corpus(spark, sf_dir), path)))


def text_vectors(spark: SparkSession, sf_dir: str) -> tuple[M.Embedder, V.Index]:
    """The embedder of the documents, and the index of their vectors."""
    fitted, vectors = embedder(spark, sf_dir)
    key = fingerprint(spark, f"{sf_dir}/documents.parquet")
    index = built(spark, "text-vectors", key, lambda path: V.build(vectors.select(F.col("chunk_id").alias("vec_id"), "embedding"), path))
    return fitted, V.opened(spark, index)


@query("r12_embedded_search")
def embedded_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R12 with R2 and R3: every item's text as a vector, and the ten nearest documents found by the index; approximate, so without SQL."""
    fitted, vectors = text_vectors(spark, sf_dir)
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("content"))
    found = V.search(vectors, kept(M.embedded(items, fitted, "query_id")), 10)
    return found.select("query_id", F.col("vec_id").alias("chunk_id"), F.col("sim").alias("score"), "rank")


def _rankings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = corpus(spark, sf_dir)
    vectors = table(spark, sf_dir, "embeddings")
    lexical = L.search(index(spark, sf_dir), _within(_one_query(spark), L.scope()), R.CANDIDATES)
    # A vector without a document is a stale point: it takes a place and is dropped after fusion.
    pool = vectors.join(docs, F.col("vec_id") == F.col("chunk_id"), "left").filter(F.col("chunk_id").isNull() | R.passes(null_type=True))
    queries = vectors.filter("vec_id = 3").select(F.lit(0).cast("long").alias("query_id"), "embedding")
    return nearest(pool.filter("embedding IS NOT NULL").select(F.col("vec_id").alias("chunk_id"), "embedding"), queries, R.CANDIDATES), lexical


_HYBRID_SQL = f"""WITH {CORPUS_SQL}, ok AS (SELECT chunk_id, content FROM corpus WHERE index_status = 'approved'), {_ONE_SQL}, {bm25_sql('ok', 'q', 's')},
lexical AS ({top_sql('s', 'query_id', 'score', 'chunk_id', 20)}),
pool AS (SELECT 0 AS query_id, e.vec_id AS chunk_id, {COSINE_SQL.format('e.embedding', 'x.embedding')} AS score FROM embeddings e JOIN embeddings x ON x.vec_id = 3
  LEFT JOIN corpus c ON c.chunk_id = e.vec_id WHERE c.chunk_id IS NULL OR index_status = 'approved'),
semantic AS ({top_sql('pool', 'query_id', 'score', 'chunk_id', 20)}),
fused AS (SELECT chunk_id, s.rank AS semantic_rank, l.rank AS bm25_rank FROM semantic s FULL JOIN lexical l USING (chunk_id)),
scored AS (SELECT f.*, c.chunk_id IS NOT NULL AS known, c.title, c.url, round((coalesce(1.0 / (60 + semantic_rank), 0.0) + coalesce(1.0 / (60 + bm25_rank), 0.0)) * {PRIORITY_SQL}, 9) AS fused_score
  FROM fused f LEFT JOIN corpus c USING (chunk_id)),
best AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY fused_score DESC, chunk_id) AS rank FROM scored) WHERE rank <= {{limit}})
SELECT chunk_id, semantic_rank, bm25_rank, fused_score, rank, title, url FROM best WHERE known"""


@query("hybrid_topk", _HYBRID_SQL.format(limit=5))
def hybrid_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R5 (with R4, J3, J4, W3, W4, X1): both rankers, fused, five best with their metadata."""
    docs = corpus(spark, sf_dir)
    fused = R.fuse(*_rankings(spark, sf_dir), docs)
    return docs.select("chunk_id", "title", "url").join(F.broadcast(fused), "chunk_id").select("chunk_id", "semantic_rank", "bm25_rank", "fused_score", "rank", "title", "url")


@query("r4_rrf_fuse", _HYBRID_SQL.format(limit=20).replace(", rank, title, url FROM best", ", rank FROM best"))
def rrf_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.fuse(*_rankings(spark, sf_dir), corpus(spark, sf_dir), 20).drop("query_id")


_ASKED_SQL = "asked AS (SELECT item_id AS query_id, text, ['en', 'fr', 'xx'][item_id % 3 + 1] AS ask_topic, CASE WHEN item_id % 2 = 0 THEN 'graduate' END AS ask_type FROM benchmark)"
_RELAX_SQL = f"""WITH {CORPUS_SQL}, {_ITEMS_SQL}, {_ASKED_SQL}, ok AS (SELECT chunk_id, content FROM corpus WHERE index_status = 'approved'), {bm25_sql('ok', 'items', 's')},
v AS (SELECT unnest([0, 1, 2, 3]) AS variant),
hits AS (SELECT s.query_id, v.variant, s.chunk_id, score, url FROM s JOIN asked a ON a.query_id = s.query_id JOIN corpus c ON c.chunk_id = s.chunk_id JOIN v ON
  ((variant & 1) = 1 OR topic = ask_topic) AND ((variant & 2) = 2 OR ask_type IS NULL OR len(student_types) = 0 OR list_contains(student_types, ask_type)) AND (variant < 2 OR ask_type IS NOT NULL)),
best AS ({top_sql('hits', 'query_id, variant', 'score', 'chunk_id', 5)}),
n AS (SELECT query_id, count(DISTINCT url) FILTER (variant = 0) AS n0, count(DISTINCT url) FILTER (variant = 1) AS n1, count(DISTINCT url) FILTER (variant = 2) AS n2,
  count(DISTINCT url) FILTER (variant = 3) AS n3 FROM best GROUP BY 1),
d AS (SELECT query_id, n0 < 3 AND n1 > n0 AS dt, CASE WHEN n0 < 3 AND n1 > n0 THEN n1 ELSE n0 END AS base, CASE WHEN n0 < 3 AND n1 > n0 THEN n3 ELSE n2 END AS other FROM n)
SELECT query_id, variant, chunk_id, score, rank FROM best JOIN (SELECT query_id, CAST(dt AS INTEGER) + CASE WHEN base < 3 AND other > base THEN 2 ELSE 0 END AS variant FROM d) USING (query_id, variant)"""


@query("r7_relaxed_search", _RELAX_SQL)
def relaxed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to four filter variants a query; the first that finds enough sources is kept."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("item"), "text")
    asked = items.withColumn("ask_topic", F.element_at(F.array(F.lit("en"), F.lit("fr"), F.lit("xx")), (F.col("item") % 3 + 1).cast("int"))).withColumn("ask_type", F.when(F.col("item") % 2 == 0, "graduate"))
    variants = asked.withColumn("variant", F.explode(F.array(*map(F.lit, range(4))))).filter((F.col("variant") < 2) | F.col("ask_type").isNotNull())
    without = lambda bit, c: F.when(F.col("variant").bitwiseAND(bit) == 0, F.col(c))
    queries = variants.select(F.struct(F.col("item").alias("query_id"), "variant").alias("query_id"), "text", L.scope(without(1, "ask_topic"), without(2, "ask_type")).alias("scope"), L.scope().alias("statistics"))
    urls = corpus(spark, sf_dir).select("chunk_id", "url")
    found = kept(L.search(index(spark, sf_dir), queries, 5).select("query_id.*", "chunk_id", "score", "rank"))
    found = kept(urls.join(broadcast_if_small(found, L.SMALL), "chunk_id"))  # relax reads it twice
    return R.relax(found).select("query_id", "variant", "chunk_id", "score", "rank")


_FANOUT_SQL = f"""WITH {BATCH_SQL}, f AS (SELECT CAST(query_id // 3 AS BIGINT) AS query_id, query_id % 3 AS sub_query, chunk_id, score AS fused_score FROM ranked),
m AS (SELECT query_id, chunk_id, max(fused_score) AS fused_score FROM f GROUP BY ALL) {top_sql('m', 'query_id', 'fused_score', 'chunk_id', 20, 'query_id, chunk_id, fused_score, rank')}"""


@query("r8_w14_fanout_merge", _FANOUT_SQL)
def fanout_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three items as sub-queries of one question; each chunk once with its highest score."""
    parts = batch(spark, sf_dir).select(F.floor(F.col("query_id") / 3).alias("query_id"), (F.col("query_id") % 3).alias("sub_query"), "chunk_id", F.col("score").alias("fused_score"))
    return R.merge_fanout(parts)


RERANKED_SQL = f"""{BATCH_SQL}, terms AS (SELECT query_id, list_distinct({TOKENS_SQL.format('text')}) AS ts FROM items),
cand AS (SELECT r.query_id, r.chunk_id, content, ts, CASE WHEN len(ts) > 0 THEN round(10 * len(list_intersect(ts, list_distinct({TOKENS_SQL.format('content')}))) / len(ts), 6) ELSE 0.0 END AS rerank_score
  FROM ranked r JOIN terms USING (query_id) JOIN docs USING (chunk_id)), reranked AS ({top_sql('cand', 'query_id', 'rerank_score', 'chunk_id', 8)})"""


def reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, chunk_id, content, rerank_score, rank): the eight best of the candidates of every item."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.array_distinct(T.tokens(F.col("text"))).alias("query_terms"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))
    found = docs.join(broadcast_if_small(batch(spark, sf_dir).select("query_id", "chunk_id"), L.SMALL), "chunk_id").join(items, "query_id")  # no text but a candidate's moves
    return kept(R.rerank(found, 8).select("query_id", "chunk_id", "content", "rerank_score", "rank"))


@query("r9_w5_rerank", f"WITH {RERANKED_SQL} SELECT query_id, chunk_id, rerank_score, rank FROM reranked")
def rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R9 with the lexical scorer, W5 top 8."""
    return reranked(spark, sf_dir).drop("content")


CLASS_SQL = f"""ex AS (SELECT label AS topic, embedding FROM embeddings WHERE vec_id % 50 = 0),
sims AS (SELECT v.vec_id, v.label, topic, max({COSINE_SQL.format('v.embedding', 'ex.embedding')}) AS confidence FROM embeddings v, ex GROUP BY ALL),
best AS ({top_sql('sims', 'vec_id', 'confidence', 'topic', 1)})"""


def _classified(spark: SparkSession, sf_dir: str, threshold: float) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    exemplars = vectors.filter("vec_id % 50 = 0").select(F.col("label").alias("topic"), "embedding")
    return classify(vectors, exemplars, threshold)


@query("r10_w6_topic_classify", f"WITH {CLASS_SQL} SELECT vec_id, CASE WHEN confidence >= 0.15 THEN topic END AS topic, confidence FROM best")
def topic_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fiftieth vector is a labelled exemplar; the threshold suits the fixture's vectors."""
    return _classified(spark, sf_dir, 0.15)


@query("r11_crawl_topic", f"WITH {CLASS_SQL} SELECT vec_id, topic, confidence FROM best WHERE confidence >= 0")
def crawl_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The crawler's rule, threshold 0."""
    return _classified(spark, sf_dir, 0.0).filter(F.col("topic").isNotNull())


@query("e14_topic_accuracy", f"WITH {CLASS_SQL} SELECT label AS expected, topic AS predicted, count(*) AS n FROM best GROUP BY ALL")
def topic_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("expected"))
    return _classified(spark, sf_dir, -1.0).join(truth, "vec_id").groupBy("expected", F.col("topic").alias("predicted")).agg(F.count("*").alias("n"))


@query("a13_bm25_statistics", f"""WITH {_ALL_SQL}, q AS (SELECT 0 AS query_id, '' AS text), {bm25_sql('docs', 'q', 's')}
SELECT (SELECT n FROM s_n) AS n, (SELECT round(avgdl, 6) FROM s_n) AS avgdl, count(*) AS terms, round(avg(idf), 6) AS mean_idf, (SELECT CAST(sum(tf) AS BIGINT) FROM s_tf) AS postings FROM s_raw""")
def bm25_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A13 from the stored index: no text is read again."""
    everything = index(spark, sf_dir).scopes.filter(F.col("scope") == L.EVERYTHING)
    return everything.select("n", F.round("avgdl", 6).alias("avgdl"), "terms", F.round("mean_idf", 6).alias("mean_idf"), F.col("words").alias("postings"))


#: Filters of topic and student type, each with statistics of its own.
_FILTERS = [("en", None), (None, "graduate"), ("fr", "freshman")]
_PASSES_SQL = "SELECT chunk_id, content FROM corpus WHERE index_status = 'approved'{}{}"
_FILTERED_SQL = ", ".join(
    f"f{i} AS ({_PASSES_SQL.format('' if t is None else f' AND topic = {t!r}', '' if s is None else f' AND (len(student_types) = 0 OR list_contains(student_types, {s!r}))')}), {bm25_sql(f'f{i}', 'items', f's{i}')}"
    for i, (t, s) in enumerate(_FILTERS)
)
_UNION_SQL = " UNION ALL ".join(f"SELECT {i} AS filter, * FROM s{i}" for i in range(len(_FILTERS)))


@query("r6_filtered_scores", f"WITH {CORPUS_SQL}, {_ITEMS_SQL}, {_FILTERED_SQL}, u AS ({_UNION_SQL}) {top_sql('u', 'filter, query_id', 'score', 'chunk_id', 10, 'filter, query_id, chunk_id, score, rank')}")
def filtered_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item under three filters, scored as an index over the filtered chunks alone would."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("item"), "text")
    filters = F.array(*(F.struct(F.lit(i).alias("filter"), L.scope(*(None if c is None else F.lit(c) for c in f)).alias("scope")) for i, f in enumerate(_FILTERS)))
    queries = items.select("item", "text", F.explode(filters).alias("f")).select(F.struct("f.filter", F.col("item").alias("query_id")).alias("query_id"), "text", "f.scope", F.col("f.scope").alias("statistics"))
    return L.search(index(spark, sf_dir), queries, 10).select("query_id.*", "chunk_id", "score", "rank")


_SCOPES_SQL = """cells AS (SELECT t.topic, y.student_type, c.chunk_id, ts FROM (SELECT *, regexp_extract_all(lower(content), '[a-z0-9]+') AS ts FROM corpus WHERE index_status = 'approved') c
  JOIN (SELECT DISTINCT topic FROM corpus UNION ALL SELECT NULL) t ON t.topic IS NULL OR t.topic = c.topic
  JOIN (SELECT unnest(['freshman', 'graduate', 'transfer', NULL]) AS student_type) y ON y.student_type IS NULL OR len(student_types) = 0 OR list_contains(student_types, y.student_type)),
sizes AS (SELECT topic, student_type, count(*) AS n, avg(len(ts)) AS avgdl FROM cells GROUP BY ALL),
freq AS (SELECT topic, student_type, term, count(DISTINCT chunk_id) AS df FROM (SELECT topic, student_type, chunk_id, unnest(ts) AS term FROM cells) GROUP BY ALL)"""


@query("r6_filter_statistics", f"""WITH {CORPUS_SQL}, {_SCOPES_SQL} SELECT s.topic, s.student_type, n, round(avgdl, 6) AS avgdl, count(*) AS terms, round(avg(ln(n - df + 0.5) - ln(df + 0.5)), 6) AS mean_idf
FROM sizes s JOIN freq f ON f.topic IS NOT DISTINCT FROM s.topic AND f.student_type IS NOT DISTINCT FROM s.student_type GROUP BY s.topic, s.student_type, n, avgdl""")
def filter_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, mean length, words and mean weight of every filter of topic and student type, as the index keeps them."""
    part = lambda i: F.split("scope", "\x1f")[i]
    name = lambda i: F.when(part(i) != "*", F.substring(part(i), 2, 1 << 20))
    rows = index(spark, sf_dir).scopes.filter((F.col("scope") != L.EVERYTHING) & (F.col("terms") > 0))
    return rows.select(name(1).alias("topic"), name(2).alias("student_type"), "n", F.round("avgdl", 6).alias("avgdl"), "terms", F.round("mean_idf", 6).alias("mean_idf"))
