"""Queries of conversation turns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.operators import turns as C
from loam.operators.answers import prompt
from loam.plans.registry import query
from loam.plans.texts import _SAID_SQL, GREETING_SQL, REPLY_SQL
from loam.sources.tables import table


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.expr(_SAID_SQL).alias("text"))


_MESSAGES_SQL = f"messages AS (SELECT conv_id, turn, role, {_SAID_SQL} AS text FROM conversations)"
_SESSIONS_SQL = "sessions AS (SELECT DISTINCT conv_id, CASE WHEN conv_id % 3 = 0 THEN 'graduate' END AS student_type FROM conversations WHERE conv_id % 5 <> 0)"


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A profile for four in five conversations; one in three of these knows the student type."""
    convs = table(spark, sf_dir, "conversations").filter("conv_id % 5 <> 0").select("conv_id").distinct()
    return convs.withColumn("student_type", F.when(F.col("conv_id") % 3 == 0, "graduate"))


@query("w10_previous_user_message", f"WITH {_MESSAGES_SQL} SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS previous FROM messages WHERE role = 'user'")
def previous_user_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.previous_user_message(_messages(spark, sf_dir)).select("conv_id", "turn", "text", "previous")


@query("w10_latest_user_message", f"WITH {_MESSAGES_SQL} SELECT conv_id, arg_max(text, turn) AS text, max(turn) AS turn FROM messages WHERE role = 'user' GROUP BY conv_id")
def latest_user_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = _messages(spark, sf_dir).filter("role = 'user'")
    return users.groupBy("conv_id").agg(F.max_by("text", "turn").alias("text"), F.max("turn").alias("turn"))


_RECENT_SQL = "recent AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM messages) WHERE n <= 6)"


@query("w11_last_n_history", f"WITH {_MESSAGES_SQL}, {_RECENT_SQL} SELECT conv_id, turn, role, text, place FROM recent")
def last_n_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.recent(_messages(spark, sf_dir))


_GATED_SQL = f"""u AS (SELECT m.conv_id, turn, text, student_type, lag(text) OVER w AS previous, row_number() OVER w AS n FROM messages m LEFT JOIN sessions s ON s.conv_id = m.conv_id WHERE role = 'user' WINDOW w AS (PARTITION BY m.conv_id ORDER BY turn)),
r AS (SELECT *, CASE WHEN n > 1 AND student_type IS NULL THEN {REPLY_SQL.format('text')} END AS reply FROM u),
f AS (SELECT conv_id, min(n) AS at_n, arg_min(reply, n) AS parsed FROM r WHERE reply IS NOT NULL GROUP BY 1),
gated AS (SELECT r.conv_id, turn, text, coalesce(student_type, CASE WHEN n >= at_n THEN parsed END) AS student_type, student_type IS NULL AND n = 1 AS asks_profile,
  CASE WHEN n = at_n THEN previous ELSE text END AS question FROM r LEFT JOIN f ON f.conv_id = r.conv_id)"""


@query("st3_j13_profile_gate", f"WITH {_MESSAGES_SQL}, {_SESSIONS_SQL}, {_GATED_SQL} SELECT * FROM gated")
def profile_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST3, J13, T19."""
    return C.gated(_messages(spark, sf_dir), _sessions(spark, sf_dir))


@query("st1_st4_turn_routes", f"""WITH {_MESSAGES_SQL}, {_SESSIONS_SQL}, {_GATED_SQL} SELECT conv_id, turn, CASE WHEN asks_profile THEN 'ask_profile' WHEN {GREETING_SQL.format('text')} THEN 'greet'
  WHEN ((conv_id * 7 + turn) % 10) / 10 < 0.55 THEN 'ask_topic' ELSE 'answer' END AS route FROM gated""")
def turn_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST1, ST4: a stand-in confidence takes the classifier's place."""
    turns = C.gated(_messages(spark, sf_dir), _sessions(spark, sf_dir)).withColumn("confidence", ((F.col("conv_id") * 7 + F.col("turn")) % 10) / 10)
    return C.routes(turns, 0.55).select("conv_id", "turn", "route")


_M = "'system' || ':' || 'Answer from the context only.'"


@query("n7_prompt_assembly", f"""WITH {_MESSAGES_SQL}, {_RECENT_SQL}, h AS (SELECT conv_id, string_agg(role || ':' || text, '|' ORDER BY turn) AS hist, arg_max(text, turn) AS question FROM recent GROUP BY 1)
SELECT conv_id, {_M} || '|' || hist || CASE WHEN conv_id % 3 = 0 THEN '|system:The reader is: graduate' ELSE '' END || '|user:Context:' || chr(10) || 'none' || chr(10) || chr(10) || 'Question: ' || question AS prompt FROM h""")
def prompt_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N7, W11; messages are shown as role:content, joined by bars."""
    listed = C.recent(_messages(spark, sf_dir)).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("h"), F.max_by("text", "turn").alias("question"))
    history = F.transform("h", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    messages = prompt("Answer from the context only.", history, F.when(F.col("conv_id") % 3 == 0, "graduate"), F.lit("none"), F.col("question"))
    return listed.select("conv_id", F.array_join(F.transform(messages, lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|").alias("prompt"))
