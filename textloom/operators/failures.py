"""Rule-based failure classes and representative runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The classes, in the order in which a run lists them.
CLASSES = (
    "initial_retrieval_miss",
    "failed_exploration",
    "incomplete_evidence_coverage",
    "incorrect_evidence_composition",
    "unsupported_answer",
    "correct_evidence_wrong_conclusion",
    "budget_exhaustion",
    "excessive_repeated_tool_use",
    "invalid_tool_call",
    "malformed_final_answer",
)


def excessive_repeats(calls: Column, repeats: Column) -> Column:
    """Three repeated requests or half of all."""
    return (calls > 0) & ((repeats >= 3) | (repeats / calls >= 0.5))


def _counters() -> tuple[Column, Column, Column]:
    calls = F.coalesce("tool_call_count", F.size("tool_trace"), F.lit(0))
    repeats = F.coalesce("repeated_tool_calls", F.size(F.filter("tool_trace", lambda t: t["repeated"])), F.lit(0))
    invalid = F.coalesce("invalid_tool_calls", F.size(F.filter("tool_trace", lambda t: ~t["ok"])), F.lit(0))
    return calls, repeats, invalid


def failure_classes() -> Column:
    """All classes that apply to a nested run (see ``runs.RUN_RECORD``). They are no partition: a successful run may have some too, and a
    wrong one on full evidence with bad citations has two."""
    calls, repeats, invalid = _counters()
    none = F.array().cast("array<string>")
    gold_chunks, shown = F.coalesce("gold_evidence.chunk_ids", none), F.coalesce(F.size("initial_retrieved_chunks"), F.lit(0))
    recall = F.coalesce("retrieval_metrics.initial_chunk_recall", "retrieval_metrics.initial_document_recall", F.when((F.size(gold_chunks) > 0) & (shown <= 0), F.lit(0.0)))
    final = F.col("evidence_metrics.final_recall")
    complete = F.coalesce("evidence_metrics.all_required_accessed", final >= 1, F.lit(False))
    cited = F.array_distinct(F.coalesce("citations", none))
    gold = F.array_union(F.coalesce("gold_evidence.doc_ids", none), gold_chunks)
    share = F.when(F.size(cited) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(cited, gold)) / F.size(cited))
    unsupported = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("evidence_metrics.citation_precision", share))) < 1
    wrong = ~F.coalesce("correctness", F.lit(False))
    facts, gold_facts = F.coalesce("accessed_evidence.fact_ids", none), F.coalesce("gold_evidence.fact_ids", none)
    nothing_new = F.when(F.size(gold_facts) > 0, ~F.arrays_overlap(facts, gold_facts)).otherwise(F.size(facts) == 0)
    explored = F.when(F.col("evidence_metrics.distinct_gold_facts").isNotNull(), F.col("evidence_metrics.distinct_gold_facts") == 0).when(F.col("accessed_evidence").isNotNull(), nothing_new).otherwise(final == 0)
    over = (F.lower("termination_reason") == "budget_exhausted") | F.exists(F.coalesce("errors", F.array().cast("array<struct<stage:string,code:string,message:string>>")), lambda e: F.lower(e["code"]).isin("budget_exhausted", "budget_insufficient"))
    status = F.lower("scoring_details.parse_status")
    malformed = F.when(status.isNotNull(), ~status.isin("valid", "ok", "parsed", "true")).otherwise(F.col("parsed_answer").isNull())
    rules = (recall == 0, (F.lower("condition") == "vfs") & (calls > 0) & explored, final < 1, wrong & complete & unsupported, wrong & unsupported, wrong & complete & ~unsupported, over, excessive_repeats(calls, repeats), invalid > 0, malformed)
    return F.array_compact(F.array(*(F.when(rule, F.lit(name)) for name, rule in zip(CLASSES, rules, strict=True))))


def trace_examples(runs: DataFrame) -> DataFrame:
    """One run each, where there is one: ``vfs_win``, ``snippet_win`` and ``both_fail`` (the least task id of the primary pairs, the file-system run
    but for snippet_win) and ``excessive_tool_use`` (the wrong file-system run with most repeats). Returns example and run_key."""
    calls, repeats, _ = _counters()
    scoped = runs.select("run_key", "task_id", F.lower("condition").alias("condition"), F.coalesce("design_cell", F.lit("primary")).alias("cell"), F.coalesce("correctness", F.lit(False)).alias("won"), repeats.alias("repeats"), excessive_repeats(calls, repeats).alias("excessive"))
    primary = scoped.filter("cell = 'primary'")
    # without primary runs, all count
    some = primary.limit(1).select(F.lit(1).alias("_x"))
    scoped = primary.unionByName(scoped.join(some, F.lit(True), "left_anti"))
    first = lambda c: F.min_by(F.when(F.col("condition") == c, F.struct("run_key", "won")), F.when(F.col("condition") == c, F.col("run_key")))
    pairs = scoped.groupBy("task_id").agg(first("snippets").alias("s"), first("vfs").alias("v")).filter("s is not null and v is not null")
    kind = F.when(F.col("v.won") & ~F.col("s.won"), "vfs_win").when(F.col("s.won") & ~F.col("v.won"), "snippet_win").when(~F.col("s.won") & ~F.col("v.won"), "both_fail")
    chosen = pairs.select(kind.alias("example"), "task_id", F.when(kind == "snippet_win", F.col("s.run_key")).otherwise(F.col("v.run_key")).alias("run_key")).filter("example is not null")
    chosen = chosen.groupBy("example").agg(F.min_by("run_key", F.struct("task_id", "run_key")).alias("run_key"))
    much = scoped.filter("condition = 'vfs' and not won and excessive").agg(F.min_by("run_key", F.struct(-F.col("repeats"), "task_id", "run_key")).alias("run_key")).filter("run_key is not null")
    return chosen.unionByName(much.select(F.lit("excessive_tool_use").alias("example"), "run_key"))


def public_payload(runs: DataFrame) -> DataFrame:
    """What of a run may be shown: example runs as JSON of their public fields."""
    shown = [
        "run_key", "task_id", "condition", "design_cell", "question", "final_answer", "parsed_answer", "correctness", "citations", "termination_reason", "initial_retrieved_documents", "initial_retrieved_chunks", "gold_evidence", "tool_trace", "tool_call_count",
        "tool_calls_by_type", "successful_tool_calls", "invalid_tool_calls", "repeated_tool_calls", "accessed_evidence", "retrieval_metrics", "evidence_metrics", "token_accounting", "latency", "errors",
    ]
    return runs.select("run_key", F.to_json(F.struct(*sorted(shown)), {"ignoreNullFields": "false"}).alias("payload"))
