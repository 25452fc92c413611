"""generate, run, evaluate, report, smoke: ``python -m textloom.cli COMMAND --help``."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from textloom.operators import designs, experiment, validation
from textloom.operators.report import write_report
from textloom.operators.runs import RUN_RECORD, first_tasks, run_frame
from textloom.sources import cache, client, corpus, derived, tables
from textloom.sources.config import Config, load_config
from textloom.sources.jsonl import append_jsonl, read_jsonl


def _spark(folder: str) -> SparkSession:
    spark = SparkSession.builder.appName("textloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if spark.conf.get("spark.checkpoint.dir", None) is None and spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(f"{folder}/checkpoints")
    return spark


def _runs(spark: SparkSession, path: str, check: bool = True) -> DataFrame:
    """The run records below ``path``. With ``check``, a row that is no record, a last line that was cut off, and records that break a rule
    raise before anything is made of them."""
    made = read_jsonl(spark, path, StructType.fromDDL(RUN_RECORD), check)
    if check and (bad := validation.run_violations(made).take(5)):
        raise ValueError("; ".join(f"{r['rule']}: {r['key']}" for r in bad))
    return made


def _model(config: Config) -> client.Model:
    if config.model.provider == "mock":
        return client.KnowsTheAnswer()
    if config.model.provider != "openai_compatible":
        raise ValueError("the provider must be mock or openai_compatible")
    m = config.model
    return client.Http(m.base_url or "", m.api_key or "", m.model, temperature=m.temperature, top_p=m.top_p, seed=m.seed)


def derive(a: argparse.Namespace) -> int:
    spark = _spark(a.output)
    if Path(f"{a.output}/corpus.jsonl").exists() and not a.force:
        raise ValueError("there is a corpus already; --force replaces it")
    docs, tasks = derived.from_tables(spark, a.tables, a.seed)
    print(*corpus.write_dataset(docs, tasks, a.output))
    return 0


def run(a: argparse.Namespace) -> int:
    spark = _spark(a.runs)
    config = load_config(a.config, {"model": {"provider": a.provider}} if a.provider else None)
    bundle = corpus.load_bundle(spark, f"{a.corpus}/corpus.jsonl", f"{a.corpus}/tasks.jsonl", config.chunking.size_tokens, config.chunking.overlap_tokens)
    tasks = first_tasks(bundle.tasks, a.split, a.task_limit)
    done = None
    if a.resume and Path(f"{a.runs}/runs").exists():
        done = _runs(spark, f"{a.runs}/runs")
        expected = {"experiment_id": designs.experiment_id(config.experiment.experiment_id, config.sha256, config.experiment.seed)}
        if version := tasks.select("corpus_version").first():
            expected["corpus_version"] = version["corpus_version"]
        if other := designs.provenance_mismatches(done, expected).select("run_key").take(3):
            raise ValueError("runs of another configuration or corpus cannot be resumed: " + ", ".join(r["run_key"] for r in other))
    made = experiment.run_experiment(bundle.documents, tasks, config, _model(config), done, cache.ResponseTable(spark, a.cache) if a.cache else None).checkpoint()
    append_jsonl(made, f"{a.runs}/runs")
    print(f"{made.count()} runs")
    return 0


def evaluate(a: argparse.Namespace) -> int:
    tables.write_tables(_runs(_spark(a.output), f"{a.runs}/runs"), a.output, a.scope)
    return 0


def report(a: argparse.Namespace) -> int:
    made = _runs(_spark(a.runs), f"{a.runs}/runs")
    Path(a.output).write_text(write_report(made, run_frame(made)), encoding="utf-8")
    return 0


def smoke(a: argparse.Namespace) -> int:
    """The first tasks of a derived corpus under both conditions by the model that knows the answers."""
    spark = _spark(a.workdir)
    docs, tasks = derived.from_tables(spark, a.tables, a.seed)
    tasks = first_tasks(tasks, "eval", a.tasks)
    n = tasks.count()
    made = experiment.run_experiment(docs, tasks, load_config(overrides={"experiment": {"seed": a.seed}}, environment={}), client.KnowsTheAnswer()).checkpoint()
    if bad := experiment.smoke_violations(made, n).take(5):
        raise RuntimeError("; ".join(f"{r['rule']}: {r['key']}" for r in bad))
    append_jsonl(made, f"{a.workdir}/runs")
    tables.write_tables(made, f"{a.workdir}/tables")
    Path(f"{a.workdir}/report.md").write_text(write_report(made, run_frame(made)), encoding="utf-8")
    print(f"{made.count()} runs, {made.filter('correctness').count()} right")
    return 0


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="textloom")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("derive", help="a corpus and its tasks from tables of suppliers, nations and regions")
    c.add_argument("tables")
    c.add_argument("output")
    c.add_argument("--seed", type=int, default=42)
    c.add_argument("--force", action="store_true")
    c = sub.add_parser("run")
    c.add_argument("corpus")
    c.add_argument("runs")
    c.add_argument("--config")
    c.add_argument("--provider")
    c.add_argument("--split", default="eval")
    c.add_argument("--task-limit", type=int, default=1 << 30)
    c.add_argument("--resume", action="store_true")
    c.add_argument("--cache")
    c = sub.add_parser("evaluate")
    c.add_argument("runs")
    c.add_argument("output")
    c.add_argument("--scope", default="primary")
    c = sub.add_parser("report")
    c.add_argument("runs")
    c.add_argument("output")
    c = sub.add_parser("smoke")
    c.add_argument("tables")
    c.add_argument("workdir")
    c.add_argument("--tasks", type=int, default=8)
    c.add_argument("--seed", type=int, default=42)
    a = p.parse_args(argv)
    try:
        return {"derive": derive, "run": run, "evaluate": evaluate, "report": report, "smoke": smoke}[a.command](a)
    except ValueError as e:
        print(e, file=sys.stderr)
        return 2
    except RuntimeError as e:
        print(e, file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
