"""Inputs of the queries, derived from the driver's tables by plain SQL that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: Documents as files.
FILES = "SELECT doc_id, '/' || source || '/' || CAST(doc_id AS VARCHAR) || '.md' AS path, source AS category, text FROM documents"
#: Benchmark items as queries.
ASKED = "SELECT item_id AS query_id, text AS query FROM benchmark"
#: Calls that showed lines: a user's events in their order.
CALLS = """SELECT user_id AS run_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS INT) AS call_ordinal,
CASE event_type WHEN 'view' THEN 'grep' WHEN 'click' THEN 'read' WHEN 'purchase' THEN 'cat' ELSE 'list' END AS tool, event_type <> 'error' AS ok,
'/p' || CAST(event_id % 7 AS VARCHAR) || '.md' AS path, CAST((event_id * 37) % 300 + 1 AS INT) AS start_line, CAST((event_id * 37) % 300 + 1 + event_id % 11 AS INT) AS end_line,
CAST(event_id % 64 AS DOUBLE) AS latency_ms, event_type || CAST(event_id % 5 AS VARCHAR) AS request_key FROM events"""
#: Known facts and where they stand.
FACTS = """SELECT 'fact-' || lpad(CAST(n_nationkey AS VARCHAR), 6, '0') AS fact_id, '/p' || CAST(n_nationkey % 7 AS VARCHAR) || '.md' AS path, CAST((n_nationkey * 53) % 300 + 1 AS INT) AS line_start,
CAST((n_nationkey * 53) % 300 + 1 + n_nationkey % 4 AS INT) AS line_end, n_regionkey FROM nation"""
#: Two facts that each run needs.
NEEDED = """SELECT DISTINCT user_id AS run_id, 'fact-' || lpad(CAST((user_id + k * 7) % 25 AS VARCHAR), 6, '0') AS fact_id FROM events CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 AS k) x"""
#: Two arms of one run each for most users; shares are in quarters, so that sums of doubles are exact in any order.
RUNS = """SELECT 'exp:task-eval-' || lpad(CAST(user_id AS VARCHAR), 6, '0') || ':' || arm || ':' || cell AS run_key, 'task-eval-' || lpad(CAST(user_id AS VARCHAR), 6, '0') AS task_id, arm AS condition, cell AS design_cell,
k < 35 + b * 20 AS success, CAST((k % 5) / 4.0 AS DOUBLE) AS recall, CAST((k % 4) / 4.0 + 0.25 * (k % 2) AS DOUBLE) AS final_recall, CAST((m % 5) / 4.0 AS DOUBLE) AS precision, m % 4 = 0 AS all_required, CAST((m % 3) / 2.0 AS DOUBLE) AS cite_precision,
CAST((k % 3) / 2.0 AS DOUBLE) AS cite_recall, CAST(b * n % 9 AS INT) AS calls, CAST(CASE WHEN b = 1 AND cell = 'max_calls_2' THEN 2 WHEN b = 1 THEN 8 END AS INT) AS permitted, CAST(b * n % 3 AS INT) AS invalid, CAST(b * m % 4 AS INT) AS repeated,
CAST(500 + m * 11 AS BIGINT) AS input_tokens, CAST(20 + k AS BIGINT) AS output_tokens, CAST(1024 + 512 * (m % 4) AS BIGINT) AS token_limit, CAST(n * 2 AS DOUBLE) AS wall_ms, CAST(n AS DOUBLE) AS model_ms, CAST(m % 8 AS DOUBLE) AS retrieval_ms,
CAST(b * (m % 16) AS DOUBLE) AS tool_ms, CAST(k / 64.0 AS DOUBLE) AS cost, CAST(2 + user_id % 3 AS INT) AS hops, 'cat-' || CAST(user_id % 4 AS VARCHAR) AS category, CAST(user_id % 7 AS INT) AS distractors, CAST(m % 3 AS INT) AS gold_facts,
CASE WHEN k % 10 = 0 THEN 'budget_exhausted' WHEN k % 10 = 1 THEN 'malformed_response' ELSE 'answered' END AS termination, k % 10 <> 1 AS parsed
FROM (SELECT user_id, CASE event_id % 2 WHEN 0 THEN 'snippets' ELSE 'vfs' END AS arm, event_id % 2 AS b, CASE user_id % 5 WHEN 0 THEN 'max_calls_2' WHEN 1 THEN 'max_calls_8' ELSE 'primary' END AS cell, count(*) AS n,
(min(event_id) * 7 + max(event_id) * 13 + count(*)) % 100 AS k, (min(event_id) * 3 + max(event_id)) % 97 AS m FROM events WHERE NOT (user_id % 17 = 3 AND event_id % 2 = 1) GROUP BY user_id, event_id % 2) g"""


def views(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for name in names or TABLES:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def base(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    views(spark, sf_dir, *tables)
    return spark.sql(sql.replace("VARCHAR", "STRING"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base(spark, sf_dir, FILES, "documents")


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base(spark, sf_dir, ASKED, "benchmark")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base(spark, sf_dir, CALLS, "events")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base(spark, sf_dir, FACTS, "nation")


def needed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base(spark, sf_dir, NEEDED, "events")


def flat_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base(spark, sf_dir, RUNS, "events")


def nested_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs as nested records (see ``operators.runs.RUN_RECORD``)."""
    from pyspark.sql.types import StructType

    from textloom.operators.runs import RUN_RECORD, TURNS

    r = flat_runs(spark, sf_dir)
    c = F.col
    none = F.array().cast("array<string>")
    made = {
        "run_key": c("run_key"), "experiment_id": F.lit("exp"), "task_id": c("task_id"), "condition": c("condition"), "design_cell": c("design_cell"), "correctness": c("success"), "corpus_version": F.lit("v1"),
        "termination_reason": c("termination"), "scoring_details": F.struct(F.when(c("parsed"), "valid").otherwise("malformed").alias("parse_status"), F.lit(False).alias("mock_oracle_policy")), "citations": none,
        "gold_evidence": F.struct(F.array(F.lit("fact-000001"), F.lit("fact-000002")).alias("fact_ids"), F.array(F.lit("doc-a-0001")).alias("doc_ids"), F.array(F.lit("doc-a-0001::c0000")).alias("chunk_ids")),
        "retrieval_metrics": F.struct(c("recall").alias("initial_chunk_recall"), c("recall").alias("initial_document_recall"), F.lit(8).alias("k")),
        "evidence_metrics": F.struct(c("final_recall").alias("final_recall"), c("precision").alias("precision"), c("gold_facts").alias("distinct_gold_facts"), c("all_required").alias("all_required_accessed"), c("cite_precision").alias("citation_precision"), c("cite_recall").alias("citation_recall")),
        "tool_call_count": c("calls"), "max_tool_calls_permitted": c("permitted"), "successful_tool_calls": c("calls") - F.least("invalid", "calls"), "invalid_tool_calls": c("invalid"), "repeated_tool_calls": c("repeated"),
        "tool_calls_by_type": F.struct(c("calls").alias("grep"), F.lit(0).alias("read"), F.lit(0).alias("cat"), F.lit(0).alias("list")),
        "token_accounting": F.struct(c("token_limit").alias("limit"), c("input_tokens").alias("input_tokens_estimated"), c("output_tokens").alias("output_tokens_estimated"), (c("input_tokens") + c("output_tokens")).alias("total_tokens_estimated"), F.lit(None).cast("long").alias("input_tokens_provider"), F.lit(None).cast("long").alias("output_tokens_provider"), F.array().cast(TURNS).alias("turns")),
        "latency": F.struct("wall_ms", "model_ms", "retrieval_ms", "tool_ms"), "estimated_cost_usd": c("cost"), "hop_count": c("hops"), "category": c("category"), "distractor_count": c("distractors"),
    }
    return r.select(*(made.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(RUN_RECORD)))
