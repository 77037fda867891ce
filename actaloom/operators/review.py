"""Review of assertions: two reviewers' verdicts, the gate, agreement, precision, states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: States of a page, by what is known of it. Fixed values.
MANUAL, IMPORTED, REVIEWED = "manual-unverified", "imported-unverified", "graph-reviewed"


def verdict(state: Column) -> Column:
    """accept, reject, or null where a reviewer came to no verdict."""
    return F.when(state == "accepted", "accept").when(state == "rejected", "reject")


def reviewers(records: DataFrame, key: str, state: str, order: list[str]) -> DataFrame:
    """(key, first, second): the verdicts of an assertion's earliest and latest record; second is null if it has one record.

    Aggregated before the shuffle, so that an assertion of many records meets no task as a whole.
    """
    row = F.struct(*order, F.col(state).alias("_state"))
    both = records.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(row).alias("a"), F.max(row).alias("b"), F.count(F.lit(1)).alias("n"))
    return both.select(key, verdict(F.col("a._state")).alias("first"), F.when(F.col("n") > 1, verdict(F.col("b._state"))).alias("second"))


def gate(first: Column, second: Column, support: Column) -> Column:
    """accepted if both accept and the evidence supports the claim itself; disputed if they differ; unreviewed if one is missing; else rejected."""
    return F.when(first.isNull() | second.isNull(), "unreviewed").when(first != second, "disputed").when((first == "accept") & F.coalesce(support, F.lit(False)), "accepted").otherwise("rejected")


def agreement(verdicts: DataFrame, first: str, second: str) -> DataFrame:
    """One row (reviewed, agreed, percent) over the assertions with two verdicts."""
    both = verdicts.filter(F.col(first).isNotNull() & F.col(second).isNotNull())
    same = F.count_if(F.col(first) == F.col(second))
    return both.agg(F.count(F.lit(1)).alias("reviewed"), same.alias("agreed"), F.round(100.0 * same / F.count(F.lit(1)), 1).alias("percent"))


def precision(sample: DataFrame, judged: DataFrame, key: str, good: str) -> DataFrame:
    """One row (sample, correct, percent): judgements that are missing or unsure count as failures."""
    rows = sample.select(key).join(judged.select(key, good), key, "left").groupBy(key).agg(F.max(F.coalesce(F.col(good), F.lit(False))).alias("ok"))
    return rows.agg(F.count(F.lit(1)).alias("sample"), F.count_if("ok").alias("correct"), F.round(100.0 * F.count_if("ok") / F.count(F.lit(1)), 1).alias("percent"))


def hard_edges(candidates: DataFrame, in_text: str, in_summary: str) -> DataFrame:
    """candidates with `summary_only`: claims that a summary alone supports never become edges."""
    return candidates.withColumn("summary_only", F.coalesce(F.col(in_summary), F.lit(False)) & ~F.coalesce(F.col(in_text), F.lit(False)))


def enrichment_state(imported: Column, accepted: Column) -> Column:
    """The state of a page: imported or written by hand, and reviewed once an edge of it is accepted. It never raises `verification`."""
    return F.when(accepted, REVIEWED).when(imported, IMPORTED).otherwise(MANUAL)


def allowed(old: Column, new: Column) -> Column:
    """Whether a page may go from one state to another: states only rise, and a page written by hand is never imported."""
    return (old == new) | (new == REVIEWED) & old.isin(MANUAL, IMPORTED)
