"""Models behind interfaces, with deterministic stand-ins where none is at hand.

An AnswerModel answers a batch of prompts, a Decomposer splits questions, a SufficiencyJudge says whether
what was retrieved suffices and how to ask again. The stand-ins are column expressions.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.functions.text import tokens


class AnswerModel(Protocol):
    def answer(self, prompts: list[str]) -> list[tuple[str, bool, list[int]]]:
        """(text, grounded, citations) of each prompt."""


def model_answers(prompts: DataFrame, model: AnswerModel, failed: str = "The answer could not be made.") -> DataFrame:
    """(query_id, text, grounded, citations) of prompts(query_id, prompt); a batch that fails gets the failure text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            try:
                found = model.answer(frame["prompt"].tolist())
            except Exception:  # noqa: BLE001  a model's failure is an answer of its own
                found = [(failed, False, [])] * len(frame)
            yield pd.DataFrame({"query_id": frame["query_id"], "text": [x[0] for x in found], "grounded": [x[1] for x in found], "citations": [x[2] for x in found]})

    return prompts.select("query_id", "prompt").mapInPandas(run, "query_id long, text string, grounded boolean, citations array<int>")


def judged(scores: Column) -> Column:
    """A judge's score within 0 and 1; null where it isn't a number."""
    value = scores.try_cast("double")
    return F.when(value.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))


def decomposed(question: Column, parts: Column | None = None, most: int = 3) -> Column:
    """At most three sub-questions; the question itself where none are given."""
    given = F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != "") if parts is not None else F.array().cast("array<string>")
    return F.when(F.size(given) > 0, F.slice(given, 1, most)).otherwise(F.array(question))


def two_passes(questions: DataFrame, sufficient: Column, reformulated: Column) -> DataFrame:
    """(item_id, attempt, asked): questions as they are, or once more in other words where that doesn't suffice."""
    return questions.select("item_id", F.when(sufficient, 1).otherwise(2).alias("attempt"), F.when(sufficient, F.col("text")).otherwise(reformulated).alias("asked"))


def hashed_vectors(docs: DataFrame, key: str, dims: int) -> DataFrame:
    """(key, dim, x): signed counts of hashed tokens, scaled to length 1; zeros are left out."""
    digest = F.md5("w")
    listed = docs.select(key, F.explode(tokens(F.col("text"))).alias("w"))
    signed = listed.select(key, (F.conv(F.substring(digest, 1, 2), 16, 10).cast("int") % dims).alias("dim"), F.when(F.substring(digest, 3, 1) < "8", 1).otherwise(-1).alias("s"))
    summed = signed.groupBy(key, "dim").agg(F.sum("s").alias("x"))
    norms = summed.groupBy(key).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    return summed.filter("x <> 0").join(norms, key).select(key, "dim", F.round(F.col("x") / F.col("norm"), 6).alias("x"))
