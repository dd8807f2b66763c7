"""URL filter: host and path rules, and for all other URLs a ratio of two character language models.

Rules. A rule has a host, a path and a verdict. It fits its host and all subdomains, where the URL's path
starts with the rule's; the longest host and path wins, then the longer host, then block. Up to `INLINE` rules are one
expression on each row. More are joined: a URL has one candidate key for each pair of host and path lengths
that some rule has, so it meets its rules by equality, each different host and path once.

Models. URLs that a rule accepts or rejects train two Markov models over `ALPHABET` and a boundary, of contexts
of up to `ORDER` characters. A class's model smooths each context by the next shorter one (Witten-Bell:
what the d different followers of n occurrences leave, d / (n + d), goes to the shorter context) and skips contexts
that it has seen under `LEAST` times, so the order varies by place. A model level is a table with a row a context and its followers'
probabilities as arrays, made from the level below by one join on the context less its first character.

Filter. A URL's score is the sum of its characters' log probability ratios (accepted over rejected, in
integer millionths, so that sums don't depend on their order) over its number of characters and end. The threshold is calibrated on a
held-out part of the labelled URLs, those whose MD5 begins with one of `HELD`: of all hundredths of a nat the one with the least balanced error,
of equal ones the nearest to 0. All counts are over all labelled URLs.

Scale. The table of ratios has (letters + 1) ** ORDER contexts, 14 MB whatever the input, and goes to every task; a row
of a URL's characters is an integer or two, summed up before anything is shuffled, and sums meet their URLs by the number
of the row. Training shuffles partial counts of (letters + 1) ** (ORDER + 1) windows at most. No Python runs in tasks.

Defined results: the host is what stands between the first `://` and `/`, `?`, `#` or the end, with A-Z
lower-cased, the path what follows up to `?`, `#` or the end; without `://`, and for null, both are empty. Models read what
follows `://`, or without one the whole URL; null as an empty text. Characters outside the alphabet count as one
symbol, capital letters as small ones. Without labelled URLs of either class scores and threshold are 0, and all
is allowed; without held-out ones of either class the threshold is 0. Null rule hosts or paths fit nothing. Repeated rows get a result each; other columns are
ignored; an empty table gives no rows. Texts are read whole, of any length.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, lower_ascii, spread_table, stored

#: What models tell apart; the last stands for every other character.
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789/.-_"
EDGE = len(ALPHABET)
SYMBOLS = EDGE + 1
ORDER = 3
#: Occurrences of a context from which a class's model uses it.
LEAST = 4
HELD = "012"
MILLION, BINS, WIDEST = 1_000_000, 100, 2_000
INLINE, SMALL = 256, 100_000
# The rules of the query.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def host_and_path(url: Column) -> tuple[Column, Column]:
    place = F.instr(url, "://")
    rest = F.when(place > 0, F.substring(url, place + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.coalesce(lower_ascii(host), F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _fits(host: Column, path: Column, rule_host: Column, rule_path: Column) -> Column:
    return ((host == rule_host) | host.endswith(F.concat(F.lit("."), rule_host))) & path.startswith(rule_path)


def _first(rules: Column) -> Column:
    """The rule that wins of an array of structs of lengths, verdict and rule; null of an empty one."""
    return F.array_max(rules)


def _ranked(host: Column, path: Column, verdict: Column) -> Column:
    """A struct that is the larger, the more a rule counts."""
    lengths = (F.length(host) + F.length(path)).alias("total"), F.length(host).alias("host_length")
    return F.struct(*lengths, verdict.alias("verdict"), F.concat(host, path).alias("rule"), host.alias("rule_host"), path.alias("rule_path"))


def by_rules(urls: DataFrame, rules: DataFrame, inline: int = INLINE) -> DataFrame:
    """urls(host, path, ...) with `rule` and `rule_verdict`, null where none of rules(host, path, verdict) fits."""
    known = rules.filter("host IS NOT NULL AND path IS NOT NULL").select(_ranked(F.col("host"), F.col("path"), F.col("verdict")).alias("r"))
    some = known.limit(inline + 1).collect()
    if len(some) <= inline:
        listed = F.array(*(F.struct(*(F.lit(v).alias(k) for k, v in r["r"].asDict().items())) for r in some)) if some else F.lit(None)
        best = _first(F.filter(listed, lambda r: _fits(F.col("host"), F.col("path"), r["rule_host"], r["rule_path"]))) if some else F.lit(None)
        held = urls.withColumn("_best", best)
        return held.select("*", *((F.col(f"_best.{k}") if some else F.lit(None).cast("string")).alias(name) for k, name in (("rule", "rule"), ("verdict", "rule_verdict")))).drop("_best")
    places = urls.select("host", "path").distinct()
    lengths = [tuple(r) for r in known.select(F.length("r.rule_host"), F.length("r.rule_path")).distinct().collect()]  # pairs of lengths, not rules
    keys = F.array(*(F.struct(F.right("host", F.lit(h)).alias("rule_host"), F.left("path", F.lit(p)).alias("rule_path")) for h, p in lengths))
    asked = places.select("host", "path", F.explode(keys).alias("k")).select("host", "path", "k.*").filter(_fits(F.col("host"), F.col("path"), F.col("rule_host"), F.col("rule_path"))).distinct()
    each = known.groupBy(F.col("r.rule_host").alias("rule_host"), F.col("r.rule_path").alias("rule_path")).agg(F.max("r").alias("r"))
    best = asked.join(broadcast_if_small(each, SMALL), ["rule_host", "rule_path"]).groupBy("host", "path").agg(F.max("r").alias("r"))
    return urls.join(best.select("host", "path", F.col("r.rule").alias("rule"), F.col("r.verdict").alias("rule_verdict")), ["host", "path"], "left")


def symbols(url: Column) -> Column:
    """The URL after `://` as numbers of symbols, between ORDER boundaries before and one after."""
    place = F.instr(url, "://")
    text = lower_ascii(F.coalesce(F.when(place > 0, F.substring(url, place + 3, F.length(url))).otherwise(url), F.lit("")))
    plain = F.regexp_replace(text, r"(?s)[^a-z0-9/.\-]", "_")
    numbers = F.transform(F.filter(F.split(plain, ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    return F.concat(F.array_repeat(F.lit(EDGE), ORDER), numbers, F.array(F.lit(EDGE)))


def _context(numbers: Column, i: Column) -> Column:
    found = F.get(numbers, i)
    for k in range(1, ORDER):
        found = found * SYMBOLS + F.get(numbers, i + k)
    return found


def _places(numbers: Column) -> Column:
    return F.sequence(F.lit(0), F.size(numbers) - (ORDER + 1))


def _windows(urls: DataFrame, name: str) -> DataFrame:
    """(name, context, follower): a row a character of each URL, and one for its end. Nothing else of the URL is carried along."""
    windows = F.transform(F.array(symbols(F.col("url"))), lambda s: F.transform(_places(s), lambda i: F.struct(_context(s, i).alias("context"), F.get(s, i + ORDER).alias("follower"))))
    return urls.select(name, F.explode(F.get(windows, F.lit(0))).alias("w")).select(name, "w.*")


def window_counts(labelled: DataFrame) -> DataFrame:
    """(context, follower, allow, block) of labelled(url, rule_verdict): occurrences in each class."""
    counted = _windows(labelled, "rule_verdict").groupBy("context", "follower")
    return counted.agg(*(F.count_if(F.col("rule_verdict") == v).alias(v) for v in ("allow", "block")))


def _level(counts: DataFrame, k: int, below: DataFrame | None) -> DataFrame:
    """(context, allow array<double>, block array<double>): each follower's probability after every context of k symbols."""
    spark, size = counts.sparkSession, SYMBOLS**k
    merged = counts.groupBy((F.col("context") % size).alias("context"), "follower").agg(F.sum("allow").alias("allow"), F.sum("block").alias("block"))
    seen = merged.groupBy("context").agg(
        F.map_from_entries(F.collect_list(F.struct("follower", F.struct("allow", "block")))).alias("seen"),  # SYMBOLS entries at most
        *(f(v).alias(f"{n}_{v}") for v in ("allow", "block") for n, f in (("n", F.sum), ("d", lambda c: F.count_if(F.col(c) > 0)))),
    )
    rows = spark.range(size).select(F.col("id").cast("int").alias("context")).join(seen, "context", "left")
    if below is None:
        rows = rows.withColumns({f"low_{v}": F.array_repeat(F.lit(1.0 / SYMBOLS), SYMBOLS) for v in ("allow", "block")})
    else:
        rows = rows.withColumn("shorter", F.col("context") % (size // SYMBOLS))
        rows = rows.join(F.broadcast(below.select(F.col("context").alias("shorter"), *(F.col(v).alias(f"low_{v}") for v in ("allow", "block")))), "shorter")  # SYMBOLS ** (ORDER - 1) rows at most

    def smoothed(v: str) -> Column:
        n, d = F.col(f"n_{v}"), F.col(f"d_{v}")
        mixed = F.transform(f"low_{v}", lambda p, i: (F.coalesce(F.element_at("seen", i)[v], F.lit(0)) + d * p) / (n + d))
        return F.when(n >= LEAST, mixed).otherwise(F.col(f"low_{v}")).alias(v)

    return rows.select("context", smoothed("allow"), smoothed("block"))


def ratios(counts: DataFrame) -> DataFrame:
    """(context, ratio array<int>): for each follower the log of the two models' ratio, in millionths."""
    level = None
    for k in range(ORDER + 1):
        level = _level(counts, k, level)
        if k in (1, 2):
            level = stored(level, "url-level")
    ratio = F.transform(F.arrays_zip("allow", "block"), lambda p: F.round(MILLION * (F.log(p["allow"]) - F.log(p["block"]))).cast("int"))
    return level.select("context", ratio.alias("ratio"))


def scored(urls: DataFrame, model: DataFrame) -> DataFrame:
    """(row, bin) of urls(row, url): each row's score in hundredths of a nat, rounded down."""
    met = _windows(urls, "row").join(F.broadcast(model), "context")  # SYMBOLS ** ORDER rows, 14 MB
    sums = met.groupBy("row").agg(F.sum(F.get("ratio", F.col("follower"))).alias("total"), F.count("*").alias("n"))
    bin = F.floor(F.col("total") / (F.col("n") * (MILLION // BINS)))
    return sums.select("row", F.greatest(F.least(bin, F.lit(WIDEST)), F.lit(-WIDEST)).cast("int").alias("bin"))


def threshold(held: DataFrame) -> int:
    """The least bin to allow, of the least balanced error on held(bin, rule_verdict)."""
    counts = {v: {} for v in ("allow", "block")}
    for r in held.groupBy("rule_verdict", "bin").count().collect():  # two rows a bin at most
        counts[r["rule_verdict"]][r["bin"]] = r["count"]
    allow, block = counts["allow"], counts["block"]
    n, m = sum(allow.values()), sum(block.values())
    if not n or not m:
        return 0
    below, above = 0, m  # accepted URLs under the threshold, rejected ones from it on
    best = (above * n, WIDEST, -WIDEST)
    for t in range(-WIDEST, WIDEST + 1):
        best = min(best, (below * m + above * n, abs(t), t))
        below, above = below + allow.get(t, 0), above - block.get(t, 0)
    return best[2]


def is_held(url: Column) -> Column:
    return F.substring(F.md5(url), 1, 1).isin(*HELD)


def judged(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """pages(page_id, url) with host, path, rule, bin, threshold and verdict."""
    host, path = host_and_path(F.col("url"))
    rows = by_rules(pages.select("page_id", "url", host.alias("host"), path.alias("path")), rules)
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "url-rules")  # numbers that are written stay as they are
    labelled = rows.filter("rule_verdict IS NOT NULL").select("row", "url", "rule_verdict")
    held = is_held(F.col("url"))
    model = stored(ratios(stored(window_counts(labelled.filter(~held)), "url-windows")), "url-model")
    tested = labelled.filter(held)
    least = threshold(scored(tested, model).join(tested.select("row", "rule_verdict"), "row"))
    verdict = F.coalesce("rule_verdict", F.when(F.col("bin") >= least, "allow").otherwise("block"))
    return rows.join(scored(rows, model), "row").select("page_id", "host", "path", "rule", verdict.alias("verdict"), "bin", F.lit(least).alias("threshold"))


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    listed = F.array(*(F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in rules))
    return spark.range(1).select(F.inline(listed))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spread_table(spark, sf_dir, "pages", "page_id", "url"), rule_table(spark))


_RULES_SQL = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)


def _level_sql(k: int) -> str:
    """CTEs for contexts of k symbols: counts c, contexts x, probabilities p by window."""
    size = SYMBOLS ** (k + 1)
    low = f"1.0::DOUBLE / {SYMBOLS}" if k == 0 else "l.{0}"
    below = "" if k == 0 else f" JOIN p{k - 1} l ON l.g = c{k}.g % {SYMBOLS ** k}"
    one = lambda v: f"CASE WHEN n_{v} >= {LEAST} THEN ({v} + d_{v} * ({low.format('p_' + v)})) / (n_{v} + d_{v}) ELSE {low.format('p_' + v)} END AS p_{v}"
    return f"""c{k} AS (SELECT g % {size} AS g, sum(allow) AS allow, sum(block) AS block FROM counts GROUP BY 1),
x{k} AS (SELECT g // {SYMBOLS} AS x, sum(allow) AS n_allow, sum(block) AS n_block, count(*) FILTER (allow > 0) AS d_allow, count(*) FILTER (block > 0) AS d_block FROM c{k} GROUP BY 1),
p{k} AS (SELECT c{k}.g, {one('allow')}, {one('block')} FROM c{k} JOIN x{k} ON x = c{k}.g // {SYMBOLS}{below}),"""


OP13_SQL = f"""
WITH rules AS (SELECT * FROM (VALUES {_RULES_SQL}) r(rh, rp, rv)),
cut AS (SELECT row_number() OVER () AS r, page_id, url, instr(url, '://') AS pos, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT *, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
  '~' || regexp_replace(translate(coalesce(CASE WHEN pos > 0 THEN rest ELSE url END, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9/.\\-]', '_', 'gs') || '~' AS text FROM cut),
ruled AS (SELECT parts.*, b.rule, b.rv, substr(md5(url), 1, 1) IN ({", ".join(f"'{c}'" for c in HELD)}) AS held FROM parts LEFT JOIN
  (SELECT r, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(rv, length(rh || rp)) AS rv FROM parts JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY r) b USING (r)),
marks AS (SELECT r, rv, held, list_transform(list_concat([{EDGE}, {EDGE}], list_transform(string_split(text, ''), lambda c : CASE WHEN c = '~' THEN {EDGE} ELSE instr('{ALPHABET}', c) - 1 END)), lambda n : n::BIGINT) AS s FROM ruled),
windows AS (SELECT r, rv, held, ((s[i] * {SYMBOLS} + s[i + 1]) * {SYMBOLS} + s[i + 2]) * {SYMBOLS} + s[i + 3] AS g FROM (SELECT *, unnest(range(1, len(s) - {ORDER} + 1)) AS i FROM marks)),
counts AS (SELECT g, count(*) FILTER (rv = 'allow' AND NOT held) AS allow, count(*) FILTER (rv = 'block' AND NOT held) AS block FROM windows GROUP BY g),
{"".join(_level_sql(k) for k in range(ORDER + 1))}
scores AS (SELECT r, any_value(rv) AS rv, any_value(held) AS held, greatest(-{WIDEST}, least({WIDEST}, floor(sum(round({MILLION} * (ln(p_allow) - ln(p_block)))) / (count(*) * {MILLION // BINS}))))::INTEGER AS bin FROM windows JOIN p{ORDER} USING (g) GROUP BY r),
tested AS (SELECT rv, bin FROM scores WHERE held AND rv IS NOT NULL),
least AS (SELECT coalesce((SELECT t FROM (SELECT t, (SELECT count(*) FROM tested WHERE rv = 'allow' AND bin < t) * (SELECT count(*) FROM tested WHERE rv = 'block')
  + (SELECT count(*) FROM tested WHERE rv = 'block' AND bin >= t) * (SELECT count(*) FROM tested WHERE rv = 'allow') AS cost FROM (SELECT unnest(range(-{WIDEST}, {WIDEST + 1})) AS t))
  WHERE (SELECT count(DISTINCT rv) FROM tested) = 2 ORDER BY cost, abs(t), t LIMIT 1), 0)::INTEGER AS threshold)
SELECT page_id, host, path, rule, coalesce(rv, CASE WHEN bin >= threshold THEN 'allow' ELSE 'block' END) AS verdict, bin, threshold
FROM (SELECT r, page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule, rv FROM ruled) JOIN (SELECT r, bin FROM scores) USING (r), least
"""
