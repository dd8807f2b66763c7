"""Crawling over stored pages: links, robots, duplicates, the rejection cascade, bounded search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.functions.text import normalize_url
from loam.operators.blocks import kept


def cut(df: DataFrame) -> DataFrame:
    """df without its lineage, in the checkpoint folder; held by the executors where the session has none."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else kept(df)


def origin(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^(https?://[^/?#]+)", 1))


def absolute(base: Column, href: Column) -> Column:
    """href against base: absolute, scheme-relative, root-relative, query-only or relative to base's folder."""
    folder = F.regexp_replace(F.regexp_replace(base, r"[?#].*$", ""), r"(^https?://[^/]+/.*/|^https?://[^/]+/?)[^/]*$", "$1")
    rooted = F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/")))
    joined = (
        F.when(F.startswith(href, F.lit("/")), F.concat(F.regexp_extract(base, r"^(https?://[^/?#]+)", 1), href))
        .when(F.startswith(href, F.lit("?")), F.concat(F.regexp_replace(base, r"[?#].*$", ""), href))
        .when(href == "", base)
        .otherwise(F.concat(rooted, href))
    )
    whole = F.when(href.rlike("(?i)^[a-z][a-z0-9+.-]*:"), href).when(F.startswith(href, F.lit("//")), F.concat(F.regexp_extract(base, "^(https?:)", 1), href))
    return F.coalesce(whole, without_dots(joined))


def without_dots(url: Column) -> Column:
    """url with the segments . and .. of its path resolved."""
    parts = lambda i: F.regexp_extract(url, r"^(?i)(https?://[^/?#]*)/([^?#]*)(.*)$", i)
    segments = F.split(parts(2), "/")
    step = lambda done, x: F.when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when(x == ".", done).otherwise(F.concat(done, F.array(x)))
    resolved = F.array_join(F.aggregate(segments, F.array().cast("array<string>"), step), "/")
    ended = F.concat(resolved, F.when(parts(2).rlike(r"(^|/)\.\.?$") & (resolved != ""), "/").otherwise(""))
    return F.when(parts(2).rlike(r"(^|/)\.\.?(/|$)"), F.concat(parts(1), F.lit("/"), ended, parts(3))).otherwise(url)


# What a page is cut into: comments and elements of raw text, which are passed over, and anchors, whose attributes are kept.
# What isn't closed goes on to the end of the page, as in a browser, so a page is read once. All loops are possessive: the
# engine recurses, once a character, into those that it may have to undo.
_INSIDE = r"""(?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+"""
_RAW = "|".join(rf"<{name}\b{_INSIDE}(?:>(?:[^<]++|<(?!/{name}\b))*+|\z)" for name in ("script", "style", "textarea", "title", "template"))
_PARTS = rf"(?is)<!--(?:[^-]++|-(?!->))*+(?:-->|\z)|{_RAW}|<a([\s/]{_INSIDE})(?:>|\z)"
_PAIRS = r"""(?is)([^\s"'>/=]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>][^\s>]*+))?+"""


def hrefs(html: Column) -> Column:
    """The targets of a page's anchors, each anchor's first href; anchors without one give none."""
    inside = F.regexp_extract_all(html, F.lit(_PARTS), F.lit(1))
    pairs = lambda tag: F.arrays_zip(F.regexp_extract_all(tag, F.lit(_PAIRS), F.lit(1)).alias("name"), F.regexp_extract_all(tag, F.lit(_PAIRS), F.lit(2)).alias("value"))
    target = lambda tag: F.get(F.filter(pairs(tag), lambda p: F.lower(p["name"]) == "href"), F.lit(0))["value"]
    return F.transform(F.filter(F.transform(F.filter(inside, lambda tag: tag != ""), target), lambda v: v.isNotNull()), _attribute)


def _attribute(value: Column) -> Column:
    """An attribute's value without quotes, outer blanks and the character references that URLs have."""
    bare = F.regexp_replace(F.regexp_replace(value, r"""^["']|["']$""", ""), "&(?:amp|#38|#x26);", "&")
    return F.regexp_replace(F.regexp_replace(bare, "&(?:quot|#34|#x22);", '"'), r"^\s+|\s+$", "")


def links(pages: DataFrame) -> DataFrame:
    """(url, link): different normalised targets of the anchors of pages(url, html), those in comments and scripts left out."""
    found = pages.select("url", F.explode(hrefs(F.col("html"))).alias("href"))
    kept = found.filter(~F.col("href").rlike("^(mailto:|tel:|javascript:|#)"))
    return kept.select("url", normalize_url(absolute(F.col("url"), F.col("href"))).alias("link")).distinct()


def allowed(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """pages that no rule (origin, path prefix) of their origin disallows; origins without rules allow all."""
    path = F.regexp_replace(F.col("url"), r"^https?://[^/?#]+", "")
    asked = pages.withColumn("_origin", origin(F.col("url"))).withColumn("_path", path)
    hits = rules.select(F.col("origin").alias("_o"), F.col("prefix").alias("_p"))
    return asked.join(hits, (F.col("_origin") == F.col("_o")) & F.startswith("_path", "_p"), "left_anti").drop("_origin", "_path")


def first_of(pages: DataFrame, key: Column) -> DataFrame:
    """pages(seq, url, ...) with `survivor`: the URL of the first page with the same key."""
    keyed = pages.withColumn("_key", key)
    firsts = keyed.groupBy("_key").agg(F.min(F.struct("seq", "url")).alias("_first"))
    return keyed.join(firsts, "_key").withColumn("survivor", F.col("_first.url")).drop("_key", "_first")


def cascade(pages: DataFrame) -> DataFrame:
    """(url, status, reason) of pages(seq, url, canonical, content_hash, in_manifest, is_error, is_thin, unclassifiable).

    The first reason that holds rejects. Only accepted pages make later ones duplicates, so duplicates are
    settled in rounds: the earliest open page of both its canonical and its content group is accepted,
    and the open pages of its groups go. Unclassifiable pages are judged last; they never make duplicates.
    """
    early = F.when(F.col("in_manifest"), "already in manifest").when(F.col("is_error"), "error page").when(F.col("is_thin"), "thin content")
    staged = pages.withColumn("reason", early).select("seq", "url", "canonical", "content_hash", "unclassifiable", "reason")
    survivors = staged.filter("reason IS NULL")
    undecided = cut(survivors.filter("NOT unclassifiable").select("seq", "url", "canonical", "content_hash"))
    accepted = undecided.limit(0)
    least = lambda df, key: df.groupBy(key).agg(F.min("seq").alias("_seq"))
    while not undecided.isEmpty():
        winners = undecided.join(least(undecided, "canonical").withColumnRenamed("_seq", "_a"), "canonical").join(least(undecided, "content_hash").withColumnRenamed("_seq", "_b"), "content_hash")
        winners = cut(winners.filter("seq = _a AND seq = _b").select("seq", "url", "canonical", "content_hash"))
        accepted = accepted.unionByName(winners)
        undecided = cut(undecided.join(winners.select("canonical"), "canonical", "left_anti").join(winners.select("content_hash"), "content_hash", "left_anti").select(*winners.columns))
    by = lambda key, name: accepted.select(F.col(key), F.col("seq").alias(f"_{name}_seq"), F.col("url").alias(f"_{name}"))
    judged = survivors.join(by("canonical", "c"), "canonical", "left").join(by("content_hash", "h"), "content_hash", "left")
    reason = (
        F.when(F.col("_c_seq") < F.col("seq"), F.concat(F.lit("duplicate canonical: "), F.col("_c")))
        .when(F.col("_h_seq") < F.col("seq"), F.concat(F.lit("duplicate content of "), F.col("_h")))
        .when(F.col("unclassifiable"), "unclassifiable")
    )
    late = judged.select("url", reason.alias("reason"))
    decided = staged.filter("reason IS NOT NULL").select("url", "reason").unionByName(late)
    return decided.select("url", F.when(F.col("reason").isNull(), "accepted").otherwise("rejected").alias("status"), "reason")


def reason_counts(decided: DataFrame) -> DataFrame:
    """(reason, n) of rejections, by the text before a parenthesis or colon."""
    key = F.split_part(F.split_part("reason", F.lit(" ("), F.lit(1)), F.lit(":"), F.lit(1))
    return decided.filter("status = 'rejected'").groupBy(key.alias("reason")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason")


def same_site(seed_url: Column, prefixes: Column, link: Column) -> Column:
    """Whether a link stays on the host of its seed, and under one of the seed's path prefixes if it has any."""
    path = F.regexp_replace(F.regexp_replace(link, r"(?i)^https?://[^/?#]+", ""), "[?#].*$", "")
    under = F.exists(prefixes, lambda p: F.startswith(path, p))
    return (origin(link) == origin(seed_url)) & (prefixes.isNull() | (F.size(prefixes) <= 0) | under)


def bounded_search(seeds: DataFrame, edges: DataFrame, max_depth: int, max_pages: int, keep: Column | None = None) -> DataFrame:
    """(seed, node, depth): nodes that each seed reaches over edges(source, target), nearest first, at most max_pages.

    Visited nodes are per seed. keep: which links of a seed are followed, of its columns and `target`. A level
    takes no more nodes than its seed has pages left, so that none grows beyond the bound.
    """
    within = Window.partitionBy("seed").orderBy("node")
    reached = cut(seeds.select("seed", F.col("seed").alias("node"), F.lit(0).alias("depth")))
    frontier = reached
    for depth in range(1, max_depth + 1):
        step = frontier.select("seed", "node").join(edges, F.col("node") == F.col("source")).join(seeds, "seed")
        step = (step.filter(keep) if keep is not None else step).select("seed", F.col("target").alias("node")).distinct()
        fresh = step.join(reached.select("seed", "node"), ["seed", "node"], "left_anti")
        left = reached.groupBy("seed").agg((F.lit(max_pages) - F.count("*")).alias("_left"))
        chosen = fresh.join(left, "seed").withColumn("_n", F.row_number().over(within)).filter(F.col("_n") <= F.col("_left"))
        frontier = cut(chosen.select("seed", "node", F.lit(depth).alias("depth")))
        reached = reached.unionByName(frontier)
    return reached
