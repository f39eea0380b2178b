"""Comparison of the phases of one process: ranked lists, and answers with the decisions expected of them.

Defined cases: an item that a list repeats counts at its best rank; null ranks are no ranks; a phase without a query's list
has an empty one; null decisions equal nothing; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import quality

READY, BLOCKED = "CustomerReady", "Blocked"


def rank_changes(before: DataFrame, after: DataFrame, keys: list[str], item: list[str], rank: str = "rank") -> DataFrame:
    """(keys..., item..., change, before, after, moved): each item of two ranked lists, by one full outer join: entered, left, risen,
    fallen or same, with its ranks and by how many places it rose."""
    side = lambda rows, name: rows.filter(F.col(rank).isNotNull()).groupBy(*keys, *item).agg(F.min(rank).alias(name))
    both = side(before, "before").join(side(after, "after"), [*keys, *item], "full_outer")
    moved = F.col("before") - F.col("after")
    change = F.when(F.col("before").isNull(), "entered").when(F.col("after").isNull(), "left").when(moved > 0, "risen").when(moved < 0, "fallen").otherwise("same")
    return both.select(*keys, *item, change.alias("change"), "before", "after", moved.alias("moved"))


def change_summary(changes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., items, a count of each change, overlap, farthest): how many items both lists have of all, and the most places that one
    moved."""
    kinds = ["entered", "left", "risen", "fallen", "same"]
    n = F.count("*")
    shared = F.count_if(F.col("moved").isNotNull())
    return changes.groupBy(*keys).agg(n.alias("items"), *(F.count_if(F.col("change") == k).alias(k) for k in kinds), F.round(shared / n, 6).alias("overlap"), F.coalesce(F.max(F.abs("moved")), F.lit(0)).alias("farthest"))


def all_changes(lists: DataFrame, phases: list[str], keys: list[str], item: list[str]) -> DataFrame:
    """``rank_changes`` between each phase of ``lists`` (phase, keys..., item..., rank) and the next, with both names (from, to)."""
    out = None
    for a, b in zip(phases, phases[1:], strict=False):
        of = lambda p: lists.filter(F.col("phase") == p)
        part = rank_changes(of(a), of(b), keys, item).withColumns({"from": F.lit(a), "to": F.lit(b)})
        out = part if out is None else out.unionByName(part)
    return out


def phase_answers(cases: DataFrame, phases: list[str], product: str | None = None) -> DataFrame:
    """Each case (case_id, question, evidence, insufficient_reasons, expected_decision, expected_unsupported, answers: a map from phase
    to answer) once for each phase, evaluated (``quality.evaluated``): all phases in one pass, what rests on question and evidence
    once for all of them."""
    at = F.explode(F.array(*map(F.lit, phases)))
    rows = quality.supported(cases, product).withColumn("phase", at).withColumn("answer", F.col("answers")[F.col("phase")]).drop("answers")
    return quality.evaluated(rows, product)


def phase_report(evaluated: DataFrame) -> DataFrame:
    """Means, rates and counts of each phase of ``phase_answers`` (``quality.report``) with what its gate finds: answers taken for ready
    that should not be, ready ones that are blocked, those whose decision or unsupported claims are not as expected, and
    the status, which fails for any of these."""
    expected, got = F.col("expected_decision"), F.col("decision")
    wrong = ~(got.eqNullSafe(expected) & F.col("unsupported_claims").eqNullSafe(F.col("expected_unsupported")))
    gate = evaluated.groupBy("phase").agg(
        F.count_if((expected != READY) & (got == READY)).alias("false_positives"),
        F.count_if((expected == READY) & (got == BLOCKED)).alias("false_negatives"),
        F.count_if(wrong).alias("mismatches"),
    )
    failed = (F.col("false_positives") > 0) | (F.col("false_negatives") > 0) | (F.col("mismatches") > 0)
    return quality.report(evaluated, ["phase"]).join(gate, "phase").withColumn("status", F.when(failed, "failed").otherwise("passed"))
