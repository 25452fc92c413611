"""Grouped summaries of the flat run frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators.designs import CONDITIONS

#: Columns whose plain mean over the rows that have them is reported, in the order of the report.
BEFORE_CALLS = ("initial_chunk_recall", "initial_document_recall", "initial_retrieved_document_count", "initial_retrieved_chunk_count", "retrieval_k", "final_evidence_recall", "evidence_precision", "distinct_gold_facts", "accessed_fact_count", "accessed_document_count", "accessed_chunk_count", "accessed_line_range_count")
CITED = ("citation_precision", "citation_recall")
AFTER_CALLS = ("successful_tool_calls", "invalid_tool_calls", "repeated_tool_calls", "grep_calls", "read_calls", "cat_calls", "list_calls", "unique_files_read_count", "unique_line_ranges_accessed_count", "time_to_first_gold_fact_ms", "calls_to_complete_gold_coverage")
TIMES = ("wall_ms", "model_ms", "retrieval_ms", "tool_ms")
OUTCOMES = ("both_succeed", "snippets_only", "vfs_only", "both_fail")


def metrics() -> list[Column]:
    """The 43 metrics of a group of runs. Means leave nulls out; sums count them as 0 and are divided by all rows."""
    n = F.count(F.lit(1))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    won = F.count_if(F.col("success"))
    means = lambda names: [F.avg(c).alias(f"{c}_mean") for c in names]
    tokens, calls, cost = total("total_tokens").cast("long"), total("tool_call_count").cast("long"), total("estimated_cost_usd").cast("double")
    return [
        n.alias("n"),
        won.alias("successes"),
        (won / n).alias("success_rate"),
        *means(BEFORE_CALLS),
        F.avg(F.col("all_required_accessed").cast("int")).alias("all_required_accessed_rate"),
        *means(CITED),
        calls.alias("actual_tool_calls"),
        (calls / n).alias("actual_tool_calls_mean"),
        *means(AFTER_CALLS),
        tokens.alias("total_tokens"),
        (tokens / n).alias("total_tokens_mean"),
        total("input_tokens").cast("long").alias("input_tokens"),
        total("output_tokens").cast("long").alias("output_tokens"),
        *means(TIMES),
        cost.alias("total_cost_usd"),
        (cost / n).alias("mean_cost_usd"),
        F.try_divide(won * 1000, tokens).alias("success_per_1000_tokens"),
        F.lit("ok").alias("status"),
    ]


def or_not_run(df: DataFrame, status: str = "not_run") -> DataFrame:
    """``df``, or one row of nulls with a status where it has none."""
    spark = df.sparkSession
    one = spark.range(1).select(*(F.lit(status if f.name == "status" else None).cast(f.dataType).alias(f.name) for f in df.schema))
    some = df.select(F.lit(1).alias("_some")).limit(1)
    return df.unionByName(one.join(some, F.lit(True), "left_anti"))


def condition_summary(frame: DataFrame) -> DataFrame:
    return frame.groupBy("condition", "design_cell").agg(*metrics())


def subgroup_summary(frame: DataFrame) -> DataFrame:
    """Two groupings in one pass, by hop count and by category; rows without the level are left out."""
    both = frame.withColumn("_g", F.explode(F.array(F.struct(F.lit("hop_count").alias("subgroup"), F.col("hop_count").cast("string").alias("level")), F.struct(F.lit("category").alias("subgroup"), F.col("category").alias("level")))))
    return both.filter("_g.level is not null").groupBy(F.col("_g.subgroup").alias("subgroup"), F.col("_g.level").alias("level"), "condition", "design_cell").agg(*metrics())


def intervention_summary(frame: DataFrame) -> DataFrame:
    """File-system runs of the intervention by permitted limit, which the cell's name gives where the run has none."""
    some = frame.filter(F.col("design_cell").startswith("max_calls_") & (F.col("condition") == "vfs"))
    limit = F.coalesce("max_tool_calls_permitted", F.regexp_extract("design_cell", r"(\d+)$", 1).try_cast("int"))
    return some.groupBy("condition", limit.alias("permitted_call_limit"), "design_cell").agg(*metrics())


def efficiency_summary(frame: DataFrame) -> DataFrame:
    return frame.groupBy("condition", "budget_bucket").agg(*metrics())


def paired(frame: DataFrame, strict: bool = False) -> DataFrame:
    """One row for each primary task that both conditions ran: task_id and, with the prefixes s_ and v_, the columns of both. A condition's
    first run by key counts. ``strict`` raises on a task that lacks a condition or has one twice."""
    primary = frame.filter((F.col("design_cell") == "primary") & F.col("condition").isin(*CONDITIONS))
    columns = [c for c in frame.columns if c not in ("task_id", "condition")]
    sides = primary.groupBy("task_id").agg(*(F.count_if(F.col("condition") == c).alias(f"_{c}") for c in CONDITIONS), *(_side(columns, c).alias(p) for c, p in zip(CONDITIONS, ("s", "v"), strict=True)))
    if strict and (wrong := sides.filter("_snippets <> 1 or _vfs <> 1").select("task_id").take(1)):
        raise ValueError(f"task {wrong[0]['task_id']} does not have each condition once")
    both = sides.filter("_snippets > 0 and _vfs > 0")
    return both.select("task_id", *(F.col(f"{p}.{c}").alias(f"{p}_{c}") for p in ("s", "v") for c in columns))


def _side(columns: list[str], condition: str) -> Column:
    """The condition's columns of its first run."""
    mine = F.col("condition") == condition
    return F.min_by(F.when(mine, F.struct(*columns)), F.when(mine, F.coalesce("run_key", F.lit(""))))


def outcome(s: Column, v: Column) -> Column:
    return F.when(s & v, OUTCOMES[0]).when(s & ~v, OUTCOMES[1]).when(~s & v, OUTCOMES[2]).when(~s & ~v, OUTCOMES[3])


def paired_counts(frame: DataFrame) -> DataFrame:
    """outcome, count, n, rate of the paired primary tasks; all four outcomes are there, with 0 where none has it."""
    pairs = paired(frame).select(outcome(F.coalesce("s_success", F.lit(False)), F.coalesce("v_success", F.lit(False))).alias("outcome"))
    every = frame.sparkSession.createDataFrame([(o,) for o in OUTCOMES], "outcome string")
    counted = every.join(pairs.groupBy("outcome").agg(F.count(F.lit(1)).alias("count")), "outcome", "left").select("outcome", F.coalesce("count", F.lit(0)).alias("count"))
    n = counted.agg(F.sum("count").alias("n"))
    return counted.crossJoin(F.broadcast(n)).withColumn("rate", F.try_divide(F.col("count"), F.col("n")))  # one row


def paired_outcomes(frame: DataFrame, resamples: int = 10_000, seed: int = 20250308, confidence: float = 0.95) -> DataFrame:
    """``paired_counts`` with the paired statistics beside each outcome; status tells of tasks that lack a condition or have one twice."""
    from textloom.operators.statistics import paired_summary

    primary = frame.filter((F.col("design_cell") == "primary") & F.col("condition").isin(*CONDITIONS))
    per = primary.groupBy("task_id").agg(*(F.count_if(F.col("condition") == c).alias(c) for c in CONDITIONS))
    state = per.agg(F.when(F.coalesce(F.bool_or((F.col("snippets") > 1) | (F.col("vfs") > 1)), F.lit(False)), "duplicate_primary_record").when(F.coalesce(F.bool_or((F.col("snippets") == 0) | (F.col("vfs") == 0)), F.lit(False)), "incomplete_pairs").otherwise("ok").alias("status"))
    stats = paired_summary(frame, resamples, seed, confidence).drop("n", "resamples", "seed")
    return paired_counts(frame).crossJoin(F.broadcast(stats)).crossJoin(F.broadcast(state))  # one row each


def task_level(frame: DataFrame) -> DataFrame:
    """One row a cell and task, the two conditions side by side."""
    known = frame.filter(F.col("condition").isin(*CONDITIONS))
    side = lambda c, of: F.max_by(F.when(F.col("condition") == of, F.col(c)), F.when(F.col("condition") == of, F.coalesce("run_key", F.lit(""))))
    g = known.groupBy("design_cell", "task_id")
    both = {"success": "success", "total_tokens": "total_tokens", "initial_recall": "initial_recall", "final_recall": "final_recall", "actual_tool_calls": "tool_call_count", "permitted_tool_calls": "max_tool_calls_permitted", "wall_ms": "wall_ms", "cost_usd": "estimated_cost_usd"}
    shared = [F.coalesce(*(F.max(F.when(F.col("condition") == c, F.col(x))) for c in CONDITIONS)).alias(x) for x in ("split", "category", "hop_count", "distractor_count")]
    wide = g.agg(*shared, *(side(c, of).alias(f"{of}_{name}") for name, c in both.items() for of in CONDITIONS), F.count_distinct("condition").alias("_sides"))
    status = F.when(F.col("_sides") == 2, "ok").otherwise("incomplete_pair")
    return wide.withColumn("paired_outcome", outcome(F.col("snippets_success"), F.col("vfs_success"))).withColumn("status", status).drop("_sides")


def failure_summary(runs: DataFrame) -> DataFrame:
    """condition, design_cell, failure_class, count, n (runs of the group), rate, for the classes that occur."""
    from textloom.operators.failures import failure_classes

    labelled = runs.select("condition", F.coalesce("design_cell", F.lit("primary")).alias("design_cell"), failure_classes().alias("classes"))
    n = labelled.groupBy("condition", "design_cell").agg(F.count(F.lit(1)).alias("n"))
    c = labelled.select("condition", "design_cell", F.explode("classes").alias("failure_class")).groupBy("condition", "design_cell", "failure_class").agg(F.count(F.lit(1)).alias("count"))
    same = c["condition"].eqNullSafe(n["condition"]) & (c["design_cell"] == n["design_cell"])
    return c.join(n, same).select(c["condition"], c["design_cell"], "failure_class", "count", "n", (F.col("count") / F.col("n")).alias("rate"), F.lit("ok").alias("status"))
