"""Run records and the flat frame that summaries read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators.designs import CELLS, CONDITIONS

IDS = "array<string>"
RANGE = "struct<path:string,start_line:int,end_line:int>"
#: A call of a model: what it was booked with, and what the provider counted (null where it did not say).
TURNS = "array<struct<turn:int,input_tokens:long,output_tokens:long,provider_input:long,provider_output:long>>"
#: A run as it is stored, nested.
RUN_RECORD = f"""
run_key string, experiment_id string, task_id string, condition string, design_cell string, condition_order int, question string, corpus_version string,
correctness boolean, final_answer string, parsed_answer struct<answer:string,citations:{IDS},justification:string>, citations {IDS}, termination_reason string,
scoring_details struct<parse_status:string,mock_oracle_policy:boolean>,
initial_retrieved_documents array<struct<doc_id:string,path:string,rank:int,score:double>>, initial_retrieved_chunks array<struct<chunk_id:string,doc_id:string,path:string,rank:int,score:double,start_line:int,end_line:int>>,
gold_evidence struct<fact_ids:{IDS},doc_ids:{IDS},chunk_ids:{IDS}>, accessed_evidence struct<fact_ids:{IDS},doc_ids:{IDS},chunk_ids:{IDS},line_ranges:array<{RANGE}>>,
retrieval_metrics struct<initial_chunk_recall:double,initial_document_recall:double,k:int>,
evidence_metrics struct<final_recall:double,precision:double,distinct_gold_facts:int,all_required_accessed:boolean,citation_precision:double,citation_recall:double>,
tool_trace array<struct<request_id:string,call_ordinal:int,tool:string,arguments:string,ok:boolean,error_code:string,line_ranges:array<{RANGE}>,repeated:boolean,latency_ms:double>>,
tool_call_count int, max_tool_calls_permitted int, tool_calls_by_type struct<grep:int,read:int,cat:int,list:int>, successful_tool_calls int, invalid_tool_calls int, repeated_tool_calls int,
unique_files_read {IDS}, unique_line_ranges_accessed array<{RANGE}>, time_to_first_gold_fact_ms double, calls_to_complete_gold_coverage int,
token_accounting struct<limit:long,input_tokens_estimated:long,output_tokens_estimated:long,total_tokens_estimated:long,input_tokens_provider:long,output_tokens_provider:long,turns:{TURNS}>,
latency struct<wall_ms:double,model_ms:double,retrieval_ms:double,tool_ms:double>, estimated_cost_usd double, hop_count int, category string, distractor_count int,
errors array<struct<stage:string,code:string,message:string>>, prompt_sha256 string, config_sha256 string, corpus_sha256 string
"""
BUCKETS = ("0-25%", "25-50%", "50-75%", "75-100%", "over-100%", "unknown")


def as_boolean(text: Column) -> Column:
    """true/yes/1 and false/no/0 in any case; numbers 1 and 0; null for others."""
    t = F.lower(F.btrim(text.cast("string")))
    return F.when(t.isin("true", "yes", "1", "1.0"), True).when(t.isin("false", "no", "0", "0.0"), False)


def as_number(value: Column) -> Column:
    """A finite double, or null."""
    d = value.cast("string").try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < float("inf")), d)


def as_integer(value: Column) -> Column:
    d = as_number(value)
    return F.when(d == F.floor(d), d.cast("long"))


def rank_of(value: Column, order: tuple[str, ...]) -> Column:
    """The value's place in ``order``; behind all for others."""
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, order)), value), F.lit(0)) - 1, F.lit(len(order)))


def budget_bucket(total: Column, limit: Column) -> Column:
    share = total / limit
    known = total.isNotNull() & limit.isNotNull() & (limit > 0)
    return F.when(~known, "unknown").when(share <= 0.25, BUCKETS[0]).when(share <= 0.5, BUCKETS[1]).when(share <= 0.75, BUCKETS[2]).when(share <= 1, BUCKETS[3]).otherwise(BUCKETS[4])


def in_scope(frame: DataFrame, scope: str) -> DataFrame:
    """Runs of the primary cell, of the intervention's cells, or all."""
    if scope not in ("primary", "intervention", "all"):
        raise ValueError("scope must be primary, intervention or all")
    cell = F.coalesce("design_cell", F.lit("primary"))
    return {"primary": frame.filter(cell == "primary"), "intervention": frame.filter(cell.startswith("max_calls_")), "all": frame}[scope]


def split_of(task_id: Column) -> Column:
    """The split that ``task-<split>-...`` names."""
    return F.when(task_id.startswith("task-") & (F.size(F.split(task_id, "-")) >= 3), F.split_part(task_id, F.lit("-"), F.lit(2)))


def first_tasks(tasks: DataFrame, split: str, most: int) -> DataFrame:
    return tasks.filter(F.col("split") == split).orderBy("task_id").limit(most)


def run_frame(runs: DataFrame) -> DataFrame:
    """Flat columns of nested ``runs`` (see ``RUN_RECORD``), in the order that reports use: one row each, lists as counts and as JSON."""
    n = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
    cell = F.coalesce(F.lower("design_cell"), F.lit("primary"))
    total = F.coalesce("token_accounting.total_tokens_estimated", F.col("token_accounting.input_tokens_estimated") + F.col("token_accounting.output_tokens_estimated"))
    limit = F.col("token_accounting.limit")
    calls = F.coalesce("tool_call_count", n("tool_trace"))
    permitted = F.coalesce("max_tool_calls_permitted", F.regexp_extract(cell, r"^max_calls_(\d+)$", 1).try_cast("int"))
    category = F.coalesce("category", F.nullif(F.regexp_extract(F.get("gold_evidence.doc_ids", F.lit(0)), r"^doc-(.+)-[^-]*$", 1), F.lit("")))
    hops = F.coalesce("hop_count", F.when(F.col("gold_evidence.fact_ids").isNotNull(), F.size("gold_evidence.fact_ids")))
    success = F.col("correctness")
    json = lambda c: F.to_json(c, {"ignoreNullFields": "false"})
    columns = {
        "run_key": "run_key", "experiment_id": "experiment_id", "task_id": "task_id", "split": split_of(F.col("task_id")), "condition": F.lower("condition"), "design_cell": cell, "condition_order": "condition_order",
        "question": "question", "corpus_version": "corpus_version", "correctness": success, "success": success, "final_answer": "final_answer",
        "parsed_answer": json("parsed_answer"), "parsed_answer_json": json("parsed_answer"), "parsed_answer_text": "parsed_answer.answer", "parsed_answer_justification": "parsed_answer.justification",
        "citations": json("citations"), "citations_json": json("citations"), "termination_reason": F.lower("termination_reason"),
        "initial_retrieved_document_count": n("initial_retrieved_documents"), "initial_retrieved_chunk_count": n("initial_retrieved_chunks"),
        "initial_chunk_recall": "retrieval_metrics.initial_chunk_recall", "initial_document_recall": "retrieval_metrics.initial_document_recall", "initial_recall": "retrieval_metrics.initial_chunk_recall", "retrieval_k": "retrieval_metrics.k",
        "gold_fact_count": n("gold_evidence.fact_ids"), "gold_document_count": n("gold_evidence.doc_ids"), "gold_chunk_count": n("gold_evidence.chunk_ids"),
        "accessed_fact_count": n("accessed_evidence.fact_ids"), "accessed_document_count": n("accessed_evidence.doc_ids"), "accessed_chunk_count": n("accessed_evidence.chunk_ids"), "accessed_line_range_count": n("accessed_evidence.line_ranges"),
        "final_evidence_recall": "evidence_metrics.final_recall", "final_recall": "evidence_metrics.final_recall", "evidence_precision": "evidence_metrics.precision", "distinct_gold_facts": "evidence_metrics.distinct_gold_facts",
        "all_required_accessed": "evidence_metrics.all_required_accessed", "citation_precision": "evidence_metrics.citation_precision", "citation_recall": "evidence_metrics.citation_recall",
        "tool_call_count": calls, "calls": calls, "max_tool_calls_permitted": permitted, "permitted_tool_calls": permitted,
        "successful_tool_calls": "successful_tool_calls", "invalid_tool_calls": "invalid_tool_calls", "repeated_tool_calls": "repeated_tool_calls",
        "grep_calls": "tool_calls_by_type.grep", "read_calls": "tool_calls_by_type.read", "cat_calls": "tool_calls_by_type.cat", "list_calls": "tool_calls_by_type.list",
        "unique_files_read_count": n("unique_files_read"), "unique_line_ranges_accessed_count": n("unique_line_ranges_accessed"), "time_to_first_gold_fact_ms": "time_to_first_gold_fact_ms", "calls_to_complete_gold_coverage": "calls_to_complete_gold_coverage",
        "input_tokens": "token_accounting.input_tokens_estimated", "output_tokens": "token_accounting.output_tokens_estimated", "total_tokens": total, "tokens": total, "token_limit": limit,
        "wall_ms": "latency.wall_ms", "model_ms": "latency.model_ms", "retrieval_ms": "latency.retrieval_ms", "tool_ms": "latency.tool_ms", "estimated_cost_usd": as_number(F.col("estimated_cost_usd")),
        "hop_count": hops, "hops": hops, "category": category, "task_category": category, "distractor_count": "distractor_count", "distractors": "distractor_count", "budget_bucket": budget_bucket(total, limit), "token_budget_bucket": budget_bucket(total, limit),
        "initial_retrieved_documents_json": json("initial_retrieved_documents"), "initial_retrieved_chunks_json": json("initial_retrieved_chunks"), "gold_evidence_json": json("gold_evidence"), "accessed_evidence_json": json("accessed_evidence"),
        "tool_trace_json": json("tool_trace"), "token_turns_json": json("token_accounting.turns"), "errors_json": json("errors"), "status": F.lit("ok"),
    }
    return runs.select(*((c if isinstance(c, Column) else F.col(c)).alias(k) for k, c in columns.items()))


def in_order(frame: DataFrame) -> DataFrame:
    """Rows as reports list them: by task, cell, condition, order and key; unknown values last."""
    keys = ["task_id", rank_of(F.col("design_cell"), CELLS), rank_of(F.col("condition"), CONDITIONS), "condition_order", "run_key"]
    return frame.orderBy(*(F.asc_nulls_last(k) for k in keys))


def duplicate_keys(runs: DataFrame, key: str = "run_key") -> DataFrame:
    return runs.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def run_counts(assignments: DataFrame, completed: DataFrame) -> DataFrame:
    """One row: assignments, those completed before (skipped), and pending."""
    done = completed.select("run_key", F.lit(1).alias("done")).distinct()
    return assignments.join(done, "run_key", "left").agg(F.count(F.lit(1)).alias("assigned"), F.count("done").alias("skipped"), F.count_if(F.col("done").isNull()).alias("pending"))
