"""Small result tables as files with exact names."""

from __future__ import annotations

import csv
import os
from pathlib import Path

from pyspark.sql import DataFrame

from textloom.operators import aggregates, failures, statistics
from textloom.operators.runs import in_scope, run_frame
from textloom.sources.jsonl import write_single


def summaries(runs: DataFrame, scope: str = "primary") -> dict[str, DataFrame]:
    """The nine tables of a set of nested runs, by file name."""
    frame = run_frame(runs)
    scoped = in_scope(frame, scope)
    keep = aggregates.or_not_run
    return {
        "condition_summary": keep(aggregates.condition_summary(scoped)),
        "subgroup_summary": keep(aggregates.subgroup_summary(scoped)),
        "intervention_summary": keep(aggregates.intervention_summary(in_scope(frame, "intervention"))),
        "efficiency_summary": keep(aggregates.efficiency_summary(scoped)),
        "paired_outcomes": aggregates.paired_outcomes(in_scope(frame, "primary")),
        "task_level": keep(aggregates.task_level(scoped)),
        "stratified_summary": statistics.stratified(in_scope(frame, "primary")),
        "regression_summary": statistics.within_vfs_regression(in_scope(frame, "primary")),
        "failure_summary": keep(aggregates.failure_summary(in_scope(runs, scope))),
    }


def write_csv(df: DataFrame, path: str | os.PathLike) -> None:
    """A table of few rows: a header, line feeds, nothing for null."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with open(path, "w", newline="", encoding="utf-8") as f:
        out = csv.writer(f, lineterminator="\n")
        out.writerow(df.columns)
        for row in df.toLocalIterator():
            out.writerow(["" if v is None else v for v in row])


def write_tables(runs: DataFrame, folder: str, scope: str = "primary") -> None:
    for name, df in summaries(runs, scope).items():
        write_csv(df, f"{folder}/{name}.csv")
    chosen = failures.trace_examples(runs)
    shown = failures.public_payload(runs.join(chosen, "run_key")).join(chosen, "run_key")
    write_single(f"{folder}/trace_examples.json", [{"example": r["example"], "payload": r["payload"]} for r in shown.orderBy("example").collect()])


def read_table(spark, path: str) -> tuple[DataFrame | None, str | None]:
    """A table that was written, or why it cannot be used: missing, empty, or all its rows not run or in error."""
    if not os.path.exists(path):
        return None, "missing"
    df = spark.read.csv(path, header=True)
    states = [r["status"] for r in df.select("status").distinct().collect()] if "status" in df.columns else ["ok"]
    if not states:
        return None, "empty"
    if all(s == "not_run" or (s or "").startswith("error") for s in states):
        return None, "; ".join(sorted(states))
    return df, None
