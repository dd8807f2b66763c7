"""The interfaces of models, with models of the tests' own."""

from __future__ import annotations

from pyspark.sql import functions as F

from loam import models


class Echo:
    """Answers in capitals; fails on any batch that holds the word fail."""

    def answer(self, prompts):
        if any("fail" in p for p in prompts):
            raise RuntimeError("no answer")
        return [(p.upper(), bool(p), [1, 2]) for p in prompts]


def test_answers_of_a_model_and_of_one_that_fails(spark):
    prompts = spark.createDataFrame([(1, "one"), (2, "")], "query_id long, prompt string").coalesce(1)
    found = {r["query_id"]: (r["text"], r["grounded"], r["citations"]) for r in models.model_answers(prompts, Echo()).collect()}
    assert found == {1: ("ONE", True, [1, 2]), 2: ("", False, [1, 2])}
    broken = models.model_answers(prompts.unionByName(spark.createDataFrame([(3, "fail")], prompts.schema)).coalesce(1), Echo(), "none").collect()
    assert [(r["text"], r["grounded"], r["citations"]) for r in broken] == [("none", False, [])] * 3
    assert models.model_answers(prompts.limit(0), Echo()).count() == 0


def test_scores_of_a_judge_stay_in_their_range(spark):
    rows = spark.createDataFrame([("0.5",), ("7",), ("-1",), ("n/a",), (None,)], "s string")
    assert [r[0] for r in rows.select(models.judged(F.col("s"))).collect()] == [0.5, 1.0, 0.0, None, None]


def test_questions_come_apart_in_three_at_most(spark):
    rows = spark.createDataFrame([("q", [" a ", "", "b", "c", "d"]), ("q", []), ("q", None)], "q string, parts array<string>")
    assert [r[0] for r in rows.select(models.decomposed(F.col("q"), F.col("parts"))).collect()] == [["a", "b", "c"], ["q"], ["q"]]
    assert rows.select(models.decomposed(F.col("q"))).first()[0] == ["q"]
