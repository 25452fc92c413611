"""A corpus and its tasks: typed reading with all checks, and writing."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from textloom.operators import validation
from textloom.operators.chunking import chunk_documents
from textloom.sources.jsonl import read_jsonl, sha256_file, write_single

FACTS = "facts array<struct<fact_id:string,subject:string,predicate:string,object:string,line_start:int,line_end:int>>"
DOCUMENT = f"schema_version int, corpus_version string, doc_id string, path string, category string, title string, content string, generator_seed decimal(20,0), {FACTS}"
TASK = "schema_version int, task_id string, split string, question string, canonical_answer string, acceptable_answer_variants array<string>, required_fact_ids array<string>, gold_document_ids array<string>, gold_chunk_ids array<string>, hop_count int, task_template string, category string, distractor_document_ids array<string>, distractor_count int, generator_seed decimal(20,0), corpus_version string"


class InvalidCorpus(ValueError):
    """Violations of the rules, the first of them named."""


@dataclass(frozen=True)
class Bundle:
    documents: DataFrame
    tasks: DataFrame
    chunks: DataFrame
    corpus_sha256: str | None
    tasks_sha256: str | None


def load_corpus(spark: SparkSession, path: str) -> DataFrame:
    return read_jsonl(spark, path, StructType.fromDDL(DOCUMENT))


def load_tasks(spark: SparkSession, path: str) -> DataFrame:
    return read_jsonl(spark, path, StructType.fromDDL(TASK))


def violations(documents: DataFrame, tasks: DataFrame, chunks: DataFrame) -> DataFrame:
    """rule, key of everything that is wrong with a corpus and its tasks."""
    versions = documents.select("corpus_version").unionByName(tasks.select("corpus_version")).distinct()
    mixed = versions.agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.lit("one_corpus_version").alias("rule"), F.col("n").cast("string").alias("key"))
    return validation.document_violations(documents).unionByName(validation.task_violations(tasks, documents, chunks)).unionByName(mixed)


def load_bundle(spark: SparkSession, corpus_path: str, tasks_path: str, size: int = 180, overlap: int = 30) -> Bundle:
    """Read both, cut the chunks and check all rules; raises ``InvalidCorpus`` with the first violations. Single files have digests."""
    documents, tasks = load_corpus(spark, corpus_path), load_tasks(spark, tasks_path)
    chunks = chunk_documents(documents.withColumnRenamed("content", "text"), size, overlap)
    if bad := violations(documents, tasks, chunks).take(5):
        raise InvalidCorpus("; ".join(f"{r['rule']}: {r['key']}" for r in bad))
    digest = lambda p: sha256_file(p) if os.path.isfile(p) else None
    return Bundle(documents, tasks, chunks, digest(corpus_path), digest(tasks_path))


def write_dataset(documents: DataFrame, tasks: DataFrame, folder: str) -> tuple[str, str]:
    """Two files in the order of ids; for corpora that the driver can hold. Returns their SHA-256."""
    rows = lambda df, key: (r.asDict(recursive=True) for r in df.orderBy(key).toLocalIterator())
    plain = lambda rs: ({k: int(v) if k == "generator_seed" and v is not None else v for k, v in r.items()} for r in rs)
    return write_single(f"{folder}/corpus.jsonl", plain(rows(documents, "doc_id"))), write_single(f"{folder}/tasks.jsonl", plain(rows(tasks, "task_id")))
