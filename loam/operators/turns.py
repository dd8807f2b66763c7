"""Turns of conversations in batches: history, profile questions, routes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loam.functions.text import is_greeting, reply_student_type

HISTORY = 6


def previous_user_message(messages: DataFrame) -> DataFrame:
    """User turns of messages(conv_id, turn, role, text) with the user's text before."""
    users = messages.filter("role = 'user'")
    return users.withColumn("previous", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")))


def recent(messages: DataFrame, n: int = HISTORY) -> DataFrame:
    """The last n messages of each conversation, in order, with their place from 1."""
    last = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    kept = messages.withColumn("_n", last).filter(F.col("_n") <= n).drop("_n")
    return kept.withColumn("place", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).cast("long"))


def gated(messages: DataFrame, sessions: DataFrame) -> DataFrame:
    """User turns with the student type known by then, whether the profile is asked for, and the effective question.

    A conversation without a type asks on its first turn. Later turns are tried as a reply until one
    names a type; that one answers the question before it. Conversations without a session have no type.
    """
    by_turn = Window.partitionBy("conv_id").orderBy("turn")
    users = previous_user_message(messages).join(sessions.select("conv_id", "student_type"), "conv_id", "left")
    numbered = users.withColumn("n", F.row_number().over(by_turn)).withColumn("reply", F.when((F.col("n") > 1) & F.col("student_type").isNull(), reply_student_type(F.col("text"))))
    upto = by_turn.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = by_turn.rowsBetween(Window.unboundedPreceding, -1)
    parsed = F.first("reply", ignorenulls=True)
    answers_profile = F.col("reply").isNotNull() & parsed.over(earlier).isNull()
    known = F.coalesce("student_type", parsed.over(upto))
    return numbered.select(
        "conv_id", "turn", "text", known.alias("student_type"), (F.col("student_type").isNull() & (F.col("n") == 1)).alias("asks_profile"),
        F.when(answers_profile, F.col("previous")).otherwise(F.col("text")).alias("question"),
    )


def routes(turns: DataFrame, threshold: float) -> DataFrame:
    """turns(text, asks_profile, confidence, ...) with the node that answers each: in this order of precedence."""
    route = F.when(F.col("asks_profile"), "ask_profile").when(is_greeting(F.col("text")), "greet").when(F.col("confidence") < threshold, "ask_topic").otherwise("answer")
    return turns.withColumn("route", route)
