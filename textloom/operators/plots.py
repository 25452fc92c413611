"""The ten figures' data sets; drawing them is left to whoever has a plotting library."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators import aggregates, statistics
from textloom.operators.runs import in_scope


def rate_points(frame: DataFrame, x: Column, condition: str | None = None) -> DataFrame:
    """x, condition, n and success_rate over runs that have both."""
    some = frame.filter(F.col("success").isNotNull()).withColumn("x", x.cast("double")).filter("x is not null")
    some = some if condition is None else some.filter(F.col("condition") == condition)
    return some.groupBy("x", "condition").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("success").cast("int")).alias("success_rate"))


def success_by_condition(frame: DataFrame) -> DataFrame:
    """n and success_rate of each condition's primary runs, and beside both the paired difference with its interval."""
    primary = in_scope(frame, "primary").filter("success is not null")
    rates = primary.groupBy("condition").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("success").cast("int")).alias("success_rate"))
    interval = statistics.paired_summary(frame).select("difference", "ci_lower", "ci_upper")
    return rates.crossJoin(F.broadcast(interval))  # one row


def by_hop(frame: DataFrame) -> DataFrame:
    return rate_points(in_scope(frame, "primary"), F.col("hop_count"))


def by_actual_calls(frame: DataFrame) -> DataFrame:
    return rate_points(in_scope(frame, "primary"), F.col("tool_call_count"), "vfs")


def by_permitted_calls(frame: DataFrame) -> DataFrame:
    limit = F.coalesce("max_tool_calls_permitted", F.regexp_extract("design_cell", r"(\d+)$", 1).try_cast("int"))
    return rate_points(in_scope(frame, "intervention"), limit, "vfs")


def by_initial_recall(frame: DataFrame) -> DataFrame:
    return rate_points(in_scope(frame, "primary"), F.col("initial_recall"))


def by_evidence_recall(frame: DataFrame) -> DataFrame:
    return rate_points(in_scope(frame, "primary"), F.col("final_recall"))


def by_tokens(frame: DataFrame, width: int = 256) -> DataFrame:
    """By total tokens, in steps of ``width``."""
    return rate_points(in_scope(frame, "primary"), F.floor(F.col("total_tokens") / width) * width)


def efficiency(frame: DataFrame) -> DataFrame:
    """Mean times and cost of each condition's primary runs."""
    means = ("wall_ms", "model_ms", "retrieval_ms", "tool_ms", "estimated_cost_usd")
    return in_scope(frame, "primary").groupBy("condition").agg(*(F.avg(c).alias(f"{c}_mean") for c in means))


def failure_modes(runs: DataFrame) -> DataFrame:
    """failure_class, condition, count over the nested primary runs."""
    return in_scope(aggregates.failure_summary(runs), "primary").select("failure_class", "condition", "count")


def paired_outcomes(frame: DataFrame) -> DataFrame:
    return aggregates.paired_counts(frame).select("outcome", "count")


FIGURES: dict[str, Callable[[DataFrame], DataFrame]] = {f.__name__: f for f in (success_by_condition, by_hop, by_actual_calls, by_permitted_calls, by_initial_recall, by_evidence_recall, by_tokens, efficiency, failure_modes, paired_outcomes)}
