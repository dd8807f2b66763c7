"""Usage analytics, feedback, tuning decisions and small relational helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.operators.blocks import broadcast_if_small, kept

# The tuning rule.
MIN_SAMPLES, FLAG_RATE, MARGIN, STEP, CEILING, PRECISION_SLACK = 20, 0.15, 1.0, 0.25, 3.0, 0.01


def turn_rates(turns: DataFrame) -> DataFrame:
    """One row of rates and latencies; those of nothing are null. One pass over the turns."""
    answered = F.when(F.col("intent") == "question", F.when(F.col("grounded"), 1.0).otherwise(0.0))
    percentile = lambda p: F.round(F.percentile("latency_ms", F.lit(p)), 6)
    return turns.agg(
        F.count("*").alias("turn_count"), F.round(F.avg(answered), 6).alias("grounded_rate"),
        F.round(F.avg(F.when(F.col("needs_clarification"), 1.0).otherwise(0.0)), 6).alias("clarification_rate"),
        F.round(F.avg("latency_ms"), 6).alias("latency_avg"), percentile(0.5).alias("latency_p50"), percentile(0.95).alias("latency_p95"),
    )


def feedback_ratio(rows: DataFrame) -> DataFrame:
    n = lambda rating: F.count_if(F.col("rating") == rating)
    ratio = F.try_divide(n("helpful"), n("helpful") + n("not_helpful"))
    return rows.agg(n("helpful").alias("helpful"), n("not_helpful").alias("not_helpful"), F.round(ratio, 6).alias("helpful_ratio"))


#: Bins of a round of selection; ranges that go to every task.
BINS, SMALL = 1_024, 100_000


def selected(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(k, name, low): of rows(k, v) the value at each place, counted from 0 in rising order, of wanted(k, name, place, low, high).

    low and high are a key's least and largest value. A round counts the values in BINS bins of each range that is still open and goes on
    with the bin that holds the place, from its least to its largest value, until both are the same. So a place is found by
    partial counts, in as many rounds as values share leading digits; no key's values are sorted or meet in one task.
    """
    done = None
    while True:
        wanted = kept(wanted)
        closed = wanted.filter("NOT low < high").select("k", "name", "low")
        done = closed if done is None else done.unionByName(closed)
        still = wanted.filter("low < high")
        if still.isEmpty():
            return done
        asked = broadcast_if_small(still.withColumnRenamed("k", "_k"), SMALL)
        met = rows.join(asked, F.col("k").eqNullSafe(F.col("_k")) & (F.col("v") >= F.col("low")) & (F.col("v") <= F.col("high"))).drop("_k")
        # Halves, so that ranges of opposite signs don't overflow; the order of values is that of their bins.
        share = (F.col("v") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2)
        bins = met.groupBy("k", "name", "place", F.least(F.floor(share * BINS), F.lit(BINS - 1)).alias("bin")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        before = F.coalesce(F.sum("n").over(Window.partitionBy("k", "name").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # BINS rows at most
        inside = bins.withColumn("before", before).filter((F.col("before") <= F.col("place")) & (F.col("place") < F.col("before") + F.col("n")))
        wanted = inside.select("k", "name", (F.col("place") - F.col("before")).alias("place"), "low", "high")


def nearest_rank(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Mean, p50, p95, p99 and max of each key by nearest rank, without nulls: the value at place floor(n * p) from 0, at most the last."""
    values = rows.select(F.col(key).alias("k"), F.col(value).cast("double").alias("v")).filter("v IS NOT NULL")
    sizes = kept(values.groupBy("k").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.min("v").alias("low"), F.max("v").alias("high")))
    places = F.array(*(F.struct(F.lit(name).alias("name"), F.least(F.col("n") - 1, F.floor(F.col("n") * p)).alias("place")) for name, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))))
    found = selected(values, sizes.select("k", "low", "high", F.explode(places).alias("w")).select("k", "w.*", "low", "high"))
    at = lambda name: F.round(F.max(F.when(F.col("name") == name, F.col("value"))), 6).alias(name)
    picked = found.select(F.col("k").alias("_k"), "name", F.col("low").alias("value"))
    joined = sizes.join(picked, F.col("k").eqNullSafe(F.col("_k")))
    return joined.groupBy(F.col("k").alias(key)).agg(F.round(F.max("mean"), 6).alias("mean"), at("p50"), at("p95"), at("p99"), F.round(F.max("high"), 6).alias("max"))


def tuning_candidate(rows: DataFrame, current: float) -> DataFrame:
    """Whether feedback calls for a higher rerank floor, and which; rows without a score don't count."""
    scores = F.transform("citations", lambda c: c["rerank_score"])
    low = rows.select("rating", F.array_min(F.filter(scores, lambda s: s.isNotNull())).alias("low")).filter("low IS NOT NULL")
    flagged = F.count_if((F.col("rating") == "not_helpful") & (F.col("low") < current + MARGIN))
    counted = low.agg(F.count("*").alias("eligible"), F.try_divide(flagged, F.count("*")).alias("rate"))
    enough, signal = F.col("eligible") >= MIN_SAMPLES, F.col("rate") >= FLAG_RATE
    decision = F.when(~enough, "insufficient_samples").when(~signal, "no_signal").otherwise("candidate")
    return counted.select("eligible", F.round("rate", 6).alias("flag_rate"), decision.alias("decision"), F.when(enough & signal, F.lit(min(current + STEP, CEILING))).alias("candidate"))


def regressed() -> Column:
    """Either rate fell, or context precision fell by more than the slack (where both are known)."""
    fell = lambda name, slack=0.0: F.col(f"{name}_after") < F.col(f"{name}_before") - slack
    return fell("grounded_rate") | fell("citation_sufficiency_rate") | F.coalesce(fell("context_precision", PRECISION_SLACK), F.lit(False))


def rate_limited(events: DataFrame, limit: int) -> DataFrame:
    """Requests allowed and rejected per user and minute, the first `limit` of a minute being allowed."""
    minute = F.date_trunc("minute", F.col("ts")).cast("timestamp_ntz")
    timed = events.select("user_id", "ts", "event_id", minute.alias("window_start"))
    place = F.row_number().over(Window.partitionBy("user_id", "window_start").orderBy("ts", "event_id"))
    counted = timed.withColumn("place", place).groupBy("user_id", "window_start")
    return counted.agg(F.count_if(F.col("place") <= limit).alias("allowed"), F.count_if(F.col("place") > limit).alias("rejected"))


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with the rows of new put in place of those with the same key, or added."""
    others = [c for c in old.columns if c != key]
    joined = old.join(new.select(F.col(key), *(F.col(c).alias(f"_{c}") for c in others), F.lit(True).alias("_new")), key, "full")
    return joined.select(key, *(F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in others))


def joined_parts(parts: DataFrame, key: str, limit: int) -> DataFrame:
    """Texts of parts(key, n, part) joined in the order of n by blank lines, cut to `limit` characters."""
    listed = parts.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("n", "part"))).alias("ps"), F.count("*").alias("parts"))
    return listed.select(key, F.substring(F.array_join("ps.part", "\n\n"), 1, limit).alias("joined"), "parts")
