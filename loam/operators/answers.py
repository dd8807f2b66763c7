"""Context blocks, extractive answers, routing, citations and prompts for batches of questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.functions.text import answer_terms, is_comparison, sentences

# Chunks that an answer draws on, the rerank floor, messages of history, and set phrases.
SOURCES, FLOOR, HISTORY = 5, 1.0, 6
NO_RESULTS = "No official source was found for this question."
GREETING = "Hello! Ask me about anything in the indexed documents."


def context(ranked: DataFrame) -> DataFrame:
    """(query_id, context): numbered blocks of ranked(query_id, rank, title, department, content, document_id, section_index, parent_text).

    A section's parent text stands for the first of its chunks in rank order, its own content for later ones.
    """
    place = F.row_number().over(Window.partitionBy("query_id", "document_id", "section_index").orderBy("rank"))
    body = F.when(F.col("parent_text").isNotNull() & (F.col("place") == 1), F.col("parent_text")).otherwise(F.col("content"))
    block = F.format_string("[%d] %s (%s):\n%s", F.col("rank"), F.col("title"), F.col("department"), body)
    blocks = ranked.withColumn("place", place).select("query_id", F.struct("rank", block.alias("block")).alias("b"))
    return blocks.groupBy("query_id").agg(F.array_join(F.sort_array(F.collect_list("b"))["block"], "\n\n").alias("context"))


def sentence_overlaps(ranked: DataFrame) -> DataFrame:
    """ranked(query_id, rank, content, query_terms, ...) by sentence, with the query terms each has."""
    split = ranked.select("query_id", "rank", "query_terms", F.posexplode(sentences(F.col("content"))).alias("place", "sentence"))
    return split.withColumn("shared", F.array_intersect("query_terms", answer_terms(F.col("sentence"))))


def extractive(questions: DataFrame, ranked: DataFrame, floor: float = FLOOR) -> DataFrame:
    """query_id, text, grounded, citations (null: not applicable) for questions(query_id, query_terms).

    ranked(query_id, rank, content, title, department, rerank_score): the best sentence of each of the
    first SOURCES chunks that clear the floor, most shared query terms first, then longest, then
    earliest; equal sentences once. Without any, the whole top chunk if it clears the floor.
    """
    used = ranked.filter(F.col("rank") <= SOURCES).filter(F.col("rerank_score").isNull() | (F.col("rerank_score") >= floor))
    overlaps = sentence_overlaps(used.join(questions.select("query_id", "query_terms"), "query_id"))
    order = Window.partitionBy("query_id", "rank").orderBy(F.desc(F.size("shared")), F.desc(F.length("sentence")), "place")
    best = overlaps.withColumn("n", F.row_number().over(order)).filter("n = 1").filter(F.size("shared") > 0)
    first = best.groupBy("query_id", "sentence").agg(F.min("rank").alias("rank"))
    titled = first.join(used.select("query_id", "rank", "title", "department"), ["query_id", "rank"])
    picks = titled.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "sentence", "title", "department"))).alias("picks"))
    top = ranked.filter("rank = 1").select("query_id", F.struct("title", "department", "content", "rerank_score").alias("top"))
    joined = questions.select("query_id").join(picks, "query_id", "left").join(top, "query_id", "left")
    according = lambda x, body: F.concat(F.lit("According to "), x["title"], F.lit(" ("), x["department"], F.lit("):\n\n"), body)
    one = F.col("picks")[0]
    many = F.concat(F.lit("Based on official sources:\n\n"), F.array_join(F.transform("picks", lambda p: F.concat(F.lit("- "), p["sentence"], F.lit(" ("), p["department"], F.lit(")"))), "\n"))
    n, clears = F.size("picks"), F.col("top.rerank_score").isNull() | (F.col("top.rerank_score") >= floor)
    has_picks, has_top = F.col("picks").isNotNull(), F.col("top").isNotNull()
    text = F.when(has_picks & (n == 1), according(one, one["sentence"])).when(has_picks, many).when(has_top & clears, according(F.col("top"), F.col("top.content"))).otherwise(NO_RESULTS)
    citations = F.when(has_picks, F.col("picks.rank")).when(has_top & clears, F.array(F.lit(1).cast("long"))).when(has_top, F.array().cast("array<long>"))
    return joined.select("query_id", text.alias("text"), (has_picks | (has_top & clears)).alias("grounded"), citations.alias("citations"))


def needs_synthesis(questions: DataFrame, ranked: DataFrame, answers: DataFrame) -> DataFrame:
    """(query_id, needs_synthesis): not grounded, a comparison, or terms only several sentences cover together."""
    cited = answers.select("query_id", F.explode("citations").alias("rank"))
    used = ranked.join(cited, ["query_id", "rank"]).join(questions.select("query_id", "query_terms"), "query_id")
    overlaps = sentence_overlaps(used)
    best = overlaps.groupBy("query_id").agg(F.max(F.size("shared")).alias("best"))
    covered = overlaps.select("query_id", F.explode("shared").alias("term")).groupBy("query_id").agg(F.count_distinct("term").alias("covered"))
    joined = questions.join(answers.select("query_id", "grounded"), "query_id").join(best, "query_id", "left").join(covered, "query_id", "left")
    fragmented = F.coalesce(F.col("covered") > F.col("best"), F.lit(False))
    return joined.select("query_id", (~F.col("grounded") | is_comparison(F.col("text")) | fragmented).alias("needs_synthesis"))


def citations(answers: DataFrame, ranked: DataFrame) -> DataFrame:
    """(query_id, place, rank, url): cited chunks, first of each URL; null citations cite all, out-of-range ones nothing."""
    known = ranked.select("query_id", "rank", "url")
    every = answers.filter("citations IS NULL").select("query_id").join(known, "query_id")
    some = answers.select("query_id", F.explode("citations").alias("rank")).distinct().join(known, ["query_id", "rank"])
    first = some.select("query_id", "rank", "url").unionByName(every.select("query_id", "rank", "url")).groupBy("query_id", "url").agg(F.min("rank").alias("rank"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")).cast("long"))


def routed(answers: DataFrame, needs: DataFrame, model: DataFrame) -> DataFrame:
    """answers, but the model's (query_id, text, grounded) where synthesis is needed and it is grounded."""
    m = model.select("query_id", F.col("text").alias("_text"), F.col("grounded").alias("_grounded"))
    joined = answers.join(needs, "query_id").join(m, "query_id", "left")
    use = F.col("needs_synthesis") & F.coalesce("_grounded", F.lit(False))
    return joined.select("query_id", F.when(use, F.col("_text")).otherwise(F.col("text")).alias("text"), (use | F.col("grounded")).alias("grounded"), use.alias("from_model"))


def prompt(system: str, history: Column, profile: Column, context_text: Column, question: Column) -> Column:
    """Messages for a model: system, history, profile note, context with the question."""
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    note = F.when(profile.isNotNull(), F.array(message("system", F.concat(F.lit("The reader is: "), profile)))).otherwise(F.array().cast("array<struct<role:string,content:string>>"))
    asked = F.array(message("user", F.concat(F.lit("Context:\n"), context_text, F.lit("\n\nQuestion: "), question)))
    return F.concat(F.array(message("system", F.lit(system))), history, note, asked)
