"""Tuning of the rerank floor from feedback, behind a gate that must not fall; every decision is a row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.operators.analytics import regressed, tuning_candidate

GATE = ("grounded_rate", "citation_sufficiency_rate", "context_precision")


def tuned(feedback: DataFrame, current: float, gate: Callable[[float], DataFrame], dry_run: bool = False) -> DataFrame:
    """One audit row: decision, old_value, new_value, applied, and the gate before and after.

    The gate runs at the current floor, and at the candidate's where there is one; the candidate is
    applied unless the gate regressed or the run is dry.
    """
    decision = tuning_candidate(feedback, current).first()
    candidate = decision["candidate"]
    before = gate(current).select(*(F.col(c).alias(f"{c}_before") for c in GATE))
    after = gate(candidate if candidate is not None else current).select(*(F.col(c).alias(f"{c}_after") for c in GATE))
    both = before.crossJoin(after)
    applied = F.lit(candidate is not None and not dry_run) & ~regressed()
    return both.select(
        F.lit(decision["decision"]).alias("decision"), F.lit(current).alias("old_value"), F.lit(candidate).cast("double").alias("new_value"), applied.alias("applied"),
        *(F.col(f"{c}_{when}") for c in GATE for when in ("before", "after")),
    )


def reverted(audit: DataFrame) -> DataFrame:
    """Audit rows that undo applied ones: values and gates change places."""
    swapped = [F.col(f"{c}_{other}").alias(f"{c}_{when}") for c in GATE for when, other in (("before", "after"), ("after", "before"))]
    return audit.filter("applied").select(F.lit("reverted").alias("decision"), F.col("new_value").alias("old_value"), F.col("old_value").alias("new_value"), F.lit(True).alias("applied"), *swapped)
