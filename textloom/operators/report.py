"""What a report says of a set of runs: collected once, as few rows, and written as Markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def run_set(runs: DataFrame) -> DataFrame:
    """One row on nested runs: numbers of runs and tasks, the sorted conditions, cells and corpus versions, and whether all, some
    (``mixed``) or none were made by a mock."""
    mock = F.coalesce("scoring_details.mock_oracle_policy", F.lit(False))
    some = lambda c: F.array_sort(F.collect_set(c))
    state = F.when(F.bool_and(mock), "all").when(F.bool_or(mock), "mixed").otherwise("none")
    return runs.agg(F.count(F.lit(1)).alias("n_runs"), F.count_distinct("task_id").alias("n_tasks"), some("condition").alias("conditions"), some("design_cell").alias("design_cells"), some("corpus_version").alias("corpus_versions"), state.alias("mock_state"))


def hardest_category(frame: DataFrame) -> DataFrame:
    """category and n of the category with most failed primary runs; of several, the first by name."""
    failed = frame.filter((F.col("design_cell") == "primary") & (F.col("success") == F.lit(False)) & F.col("category").isNotNull())
    return failed.groupBy("category").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "category").limit(1)


def most_recorded_failure(failures: DataFrame) -> DataFrame:
    """The failure class with the largest count over all groups; of several, the first by name."""
    return failures.groupBy("failure_class").agg(F.sum("count").alias("count")).orderBy(F.desc("count"), "failure_class").limit(1)


def number(value: float | None, digits: int = 3) -> str:
    return "n/a" if value is None else f"{value:.{digits}f}".rstrip("0").rstrip(".")


def percent(value: float | None) -> str:
    return "n/a" if value is None else f"{100 * value:.1f}%"


def table(df: DataFrame, most: int = 200) -> str:
    """A Markdown table of a result: its first ``most`` rows, and how many more there are."""
    rows = df.limit(most + 1).collect()
    more = df.count() - most if len(rows) > most else 0
    rows = rows[:most]
    cell = lambda v: number(v) if isinstance(v, float) else "" if v is None else str(v).replace("|", "\\|")
    return "\n".join(["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns), *("| " + " | ".join(map(cell, r)) + " |" for r in rows), *([f"\n{more} more rows are left out."] if more else [])])


NO_MODEL = "all runs are by a mock, which says nothing of a model"


def not_run(why: str) -> str:
    return f"Not run — {why}."


def rows_or_reason(df: DataFrame, columns: tuple[str, ...], order: tuple[str, ...], none: str) -> str:
    """The table of a summary, or why there is none: no rows, or a status that says so."""
    states = {r["status"] for r in df.select("status").distinct().collect()} if "status" in df.columns else {"ok"}
    if not states or states <= {"not_run"}:
        return not_run(none)
    if all((x or "").startswith("error") for x in states):
        return not_run("; ".join(sorted(states)))
    return table(df.orderBy(*order).select(*columns))


def paired_lines(outcome: dict) -> list[str]:
    """What the pairs show, and what follows from that."""
    if not outcome.get("n"):
        return [not_run(f"no complete pairs ({outcome.get('status')})")]
    seen = f"[observed] {outcome['n']} paired tasks: {percent(outcome['snippets_success_rate'])} right with snippets, {percent(outcome['vfs_success_rate'])} with the file system, a difference of {percent(outcome['difference'])}."
    return [seen, f"[inferred] The difference lies between {percent(outcome['ci_lower'])} and {percent(outcome['ci_upper'])}; exact paired test p = {number(outcome['mcnemar_p_value'], 4)}."]


def write_report(runs: DataFrame, frame: DataFrame, resamples: int | None = None) -> str:
    """The report's text. Runs of a mock and of a model together are refused; on a mock alone whatever would speak of a model is left out,
    with the reason. Statements are marked as observed or inferred."""
    from textloom.operators import aggregates, failures, statistics

    about = run_set(runs).first()
    if about["mock_state"] == "mixed":
        raise ValueError("runs of a mock and of a model cannot be reported together")
    mock = about["mock_state"] == "all"
    parts = ["# Run report", f"[observed] {about['n_runs']} runs over {about['n_tasks']} tasks; conditions {', '.join(about['conditions'])}; cells {', '.join(about['design_cells'])}; corpus {', '.join(about['corpus_versions'])}."]
    if mock:
        parts.append("[observed] Every run is by a mock that knows the answers: rates below are no measure of a model.")
    cost = frame.agg(F.sum("estimated_cost_usd").alias("cost"), F.avg("wall_ms").alias("wall"), F.sum("total_tokens").alias("tokens")).first()
    parts.append(f"[observed] {number(cost['tokens'] and float(cost['tokens']))} tokens and {number(cost['cost'], 4)} USD by the configured prices; {number(cost['wall'], 1)} ms a run.")
    rates = ("n", "success_rate", "total_tokens_mean", "actual_tool_calls_mean", "success_per_1000_tokens")
    parts += ["## By condition", rows_or_reason(aggregates.condition_summary(frame), ("condition", "design_cell", *rates), ("condition", "design_cell"), "there are no runs")]
    if mock:
        parts += ["## Paired test", not_run(NO_MODEL)]
    else:
        outcome = aggregates.paired_outcomes(frame, *([resamples] if resamples else [])).first()
        parts += ["## Paired test", *paired_lines(outcome.asDict() if outcome else {"n": 0, "status": "no task has both sides"})]
    strata = statistics.stratified(frame).filter("n > 0")
    parts += ["## Pairs by stratum", not_run(NO_MODEL) if mock else rows_or_reason(strata, ("stratum", "band", "n", "snippets_success_rate", "vfs_success_rate", "difference"), ("stratum", "band"), "no pair has both sides in one band")]
    parts += ["## By hops and category", rows_or_reason(aggregates.subgroup_summary(frame), ("subgroup", "level", "condition", "design_cell", *rates), ("subgroup", "level", "condition", "design_cell"), "no run names hops or a category")]
    if top := hardest_category(frame).first():
        parts.append(f"[observed] Most primary runs went wrong in {top['category']} ({top['n']}).")
    parts += ["## By share of the budget", rows_or_reason(aggregates.efficiency_summary(frame), ("condition", "budget_bucket", *rates), ("condition", "budget_bucket"), "there are no runs")]
    parts += ["## Intervention", rows_or_reason(aggregates.or_not_run(aggregates.intervention_summary(frame)), ("permitted_call_limit", "design_cell", *rates), ("permitted_call_limit",), "no run had a limit of calls of its own")]
    fit = statistics.within_vfs_regression(frame)
    status = fit.filter("term = '__status__'").first()
    if mock:
        parts += ["## Within the file system", not_run(NO_MODEL)]
    elif status is None or status["error"]:
        parts += ["## Within the file system", not_run(status["error"] if status else "there are no runs")]
    else:
        parts += ["## Within the file system", f"[inferred] Association over {status['n']} runs, not a cause; reference category {status['reference_category']}.", table(fit.filter("term <> '__status__'").select("term", "coefficient", "std_error", "ci_lower", "ci_upper", "p_value"))]
    lost = aggregates.failure_summary(runs)
    parts += ["## Failures", rows_or_reason(lost, ("condition", "design_cell", "failure_class", "count", "n", "rate"), ("condition", "design_cell", "failure_class"), "no run has a failure class")]
    if top := most_recorded_failure(lost).first():
        parts.append(f"[observed] Most recorded: {top['failure_class']} ({top['count']}). Classes overlap, so rates do not add up.")
    shown = failures.trace_examples(runs)
    parts += ["## Examples", table(shown.orderBy("example")) if shown.take(1) else not_run("no pair of runs fits an example")]
    parts += ["## What this does not say", "Token counts are estimates by one tokenizer unless a provider counted; latencies hold the waiting for other runs of a turn; strata and subgroups are looked at without a correction for their number."]
    return "\n\n".join(parts) + "\n"
