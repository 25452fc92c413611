"""Integrity of a corpus and its tasks: each rule is a query whose rows are the violations."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from textloom.functions.text import lines, normal_form
from textloom.sources.scratch import stored

#: Questions without an inner word that one automaton holds, about, and their characters.
SHORT_QUESTIONS, SHORT_CHARS = 50_000, 1 << 23
SLUG = r"^[a-z0-9]+(?:-[a-z0-9]+)*$"
DOC_ID = r"^doc-[a-z0-9]+(?:-[a-z0-9]+)*-\d{4,}$"
CHUNK_ID = r"^doc-[a-z0-9-]+::c\d{4,}$"
FACT_ID = r"^fact-\d{6,}$"
TASK_ID = r"^task-(?:dev|eval)-\d{6,}$"


def sorted_unique(ids: Column) -> Column:
    return F.array_sort(F.array_distinct(ids)) == ids


def _rule(df: DataFrame, name: str, key: str, bad: Column) -> DataFrame:
    return df.filter(F.coalesce(bad, F.lit(False))).select(F.lit(name).alias("rule"), F.col(key).cast("string").alias("key"))


def _rules(df: DataFrame, key: str, bad: dict[str, Column]) -> DataFrame:
    """The rules that each row breaks, all looked at in one pass."""
    broken = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), name) for name, c in bad.items())))
    return df.select(F.explode(broken).alias("rule"), F.col(key).cast("string").alias("key"))


def duplicates(df: DataFrame, key: str, name: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.lit(name).alias("rule"), F.col(key).cast("string").alias("key"))


def out_of_order(df: DataFrame, key: str, position: str, name: str) -> DataFrame:
    """Rows whose key does not come after the one before by ``position``. Ranges of positions are compared on their own and then their ends,
    so the check needs no single ordered partition."""
    ranged = df.select(key, position).withColumn("_part", F.floor(F.col(position) / 100_000))
    w = Window.partitionBy("_part").orderBy(position)
    inside = ranged.withColumn("_prev", F.lag(key).over(w)).filter(F.col("_prev") >= F.col(key)).select(key)
    ends = ranged.groupBy("_part").agg(F.min_by(key, position).alias("first"), F.max_by(key, position).alias("last"))
    edges = ends.withColumn("_prev", F.lag("last").over(Window.orderBy("_part"))).filter("_prev >= first").select(F.col("first").alias(key))
    return inside.unionByName(edges).select(F.lit(name).alias("rule"), F.col(key).cast("string").alias("key"))


def document_violations(docs: DataFrame) -> DataFrame:
    """``docs``: doc_id, path, category, content, facts (fact_id, line_start, line_end)."""
    n = F.size(lines(F.col("content")))
    fact = docs.select("doc_id", F.explode("facts").alias("f"), n.alias("n"))
    own = {
        "doc_id_grammar": F.col("doc_id").isNull() | ~F.rlike("doc_id", F.lit(DOC_ID)),
        "category_agrees": F.col("doc_id").isNull() | (F.regexp_extract("doc_id", r"^doc-(.+)-\d+$", 1) != F.col("category")),
        "path_agrees": ~F.startswith("path", F.concat(F.lit("/"), "category", F.lit("/"))),
    }
    return reduce(DataFrame.unionByName, [
        _rules(docs, "doc_id", own),
        _rule(fact, "fact_span", "doc_id", (F.col("f.line_start") < 1) | (F.col("f.line_end") < F.col("f.line_start")) | (F.col("f.line_end") > F.col("n"))),
        duplicates(docs, "doc_id", "doc_id_unique"),
        duplicates(docs, "path", "path_unique"),
        duplicates(fact.select("f.fact_id"), "fact_id", "fact_id_unique"),
    ])


def task_violations(tasks: DataFrame, docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """``tasks``: task_id, required_fact_ids, gold_document_ids, gold_chunk_ids, distractor_document_ids, hop_count, distractor_count;
    references are checked against ``docs`` and ``chunks`` (chunk_id) by anti joins."""
    arrays = ("required_fact_ids", "gold_document_ids", "gold_chunk_ids", "distractor_document_ids")
    outside = F.exists("gold_chunk_ids", lambda c: ~F.array_contains("gold_document_ids", F.substring_index(c, "::", 1)))
    facts = docs.select(F.explode("facts.fact_id").alias("id"))

    def missing(column: str, known: DataFrame, name: str) -> DataFrame:
        asked = tasks.select("task_id", F.explode(column).alias("id"))
        return asked.join(known, "id", "left_anti").select(F.lit(name).alias("rule"), F.col("task_id").alias("key"))

    own = {
        "task_id_grammar": F.col("task_id").isNull() | ~F.rlike("task_id", F.lit(TASK_ID)),
        **{f"{c}_sorted_unique": F.col(c).isNull() | ~sorted_unique(F.col(c)) for c in arrays},
        "hop_count": F.col("hop_count") != F.size("required_fact_ids"),
        "distractor_count": F.col("distractor_count") != F.size("distractor_document_ids"),
        "gold_and_distractors_apart": F.arrays_overlap("gold_document_ids", "distractor_document_ids"),
        "gold_chunks_in_gold_documents": outside,
    }
    return reduce(DataFrame.unionByName, [
        _rules(tasks, "task_id", own),
        duplicates(tasks, "task_id", "task_id_unique"),
        missing("required_fact_ids", facts, "facts_exist"),
        missing("gold_document_ids", docs.select(F.col("doc_id").alias("id")), "gold_documents_exist"),
        missing("distractor_document_ids", docs.select(F.col("doc_id").alias("id")), "distractors_exist"),
        missing("gold_chunk_ids", chunks.select(F.col("chunk_id").alias("id")), "gold_chunks_exist"),
    ])


def leakage_violations(tasks: DataFrame, docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Ways in which tasks could be solved too easily or splits know of each other. ``tasks``: task_id, split, question, required_fact_ids,
    gold_document_ids, distractor_document_ids; ``docs``: doc_id, facts; ``chunks``: chunk_id, doc_id, start_line, end_line.

    A task's facts stand in two documents at least, no chunk holds all of them, no document serves both splits (its key is the
    document's), and no question is asked twice (its key is the least task's)."""
    need = tasks.select("task_id", F.explode("required_fact_ids").alias("fact_id"))
    spans = docs.select("doc_id", F.explode("facts").alias("f")).select("doc_id", "f.fact_id", "f.line_start", "f.line_end")
    at = need.join(spans, "fact_id", "left")
    few = at.groupBy("task_id").agg(F.count_distinct("doc_id").alias("n")).filter("n < 2").select(F.lit("facts_in_two_documents").alias("rule"), F.col("task_id").alias("key"))
    held = at.join(chunks.select("chunk_id", "doc_id", "start_line", "end_line"), "doc_id").filter((F.col("line_start") <= F.col("end_line")) & (F.col("line_end") >= F.col("start_line")))
    most = held.groupBy("task_id", "chunk_id").agg(F.count_distinct("fact_id").alias("n")).groupBy("task_id").agg(F.max("n").alias("n"))
    whole = need.groupBy("task_id").agg(F.count_distinct("fact_id").alias("all")).join(most, "task_id").filter("n = all").select(F.lit("no_chunk_holds_all_facts").alias("rule"), F.col("task_id").alias("key"))
    uses = tasks.select("split", F.explode(F.concat("gold_document_ids", "distractor_document_ids")).alias("doc_id"))
    both = uses.groupBy("doc_id").agg(F.count_distinct("split").alias("n")).filter("n > 1").select(F.lit("splits_apart").alias("rule"), F.col("doc_id").alias("key"))
    asked = tasks.groupBy(normal_form(F.col("question")).alias("q")).agg(F.count(F.lit(1)).alias("n"), F.min("task_id").alias("key")).filter("n > 1").select(F.lit("questions_unique").alias("rule"), "key")
    return few.unionByName(whole).unionByName(both).unionByName(asked)


def leaks(tasks: DataFrame, docs: DataFrame) -> DataFrame:
    """task_id, doc_id where a document (doc_id, content) holds a task's question, character by character. Empty questions stand in none.

    A document that holds a question holds all of its parts between blanks, the first and the last perhaps as parts of longer ones.
    So a question meets only documents with its rarest inner part, and these are searched. Questions without an inner part go into automata
    of ``SHORT_QUESTIONS`` each, which find all of theirs in one pass over a document; there may be any number of them."""
    asked = tasks.select("task_id", "question", F.split("question", " ").alias("parts")).filter("question <> ''")
    inner = asked.select("task_id", F.explode(F.slice("parts", 2, F.greatest(F.size("parts") - 2, F.lit(0)))).alias("part")).distinct()
    wanted = inner.select("part").distinct()
    have = docs.select("doc_id", F.explode(F.array_distinct(F.split("content", " "))).alias("part")).join(wanted, "part", "left_semi")
    have = stored(have)
    rare = inner.join(have.groupBy("part").agg(F.count(F.lit(1)).alias("n")), "part", "left")
    anchors = rare.groupBy("task_id").agg(F.min_by("part", F.struct(F.coalesce("n", F.lit(0)), "part")).alias("part"))
    near = have.join(anchors, "part").select("task_id", "doc_id").distinct().join(asked.select("task_id", "question"), "task_id")
    found = docs.select("doc_id", "content").join(near, "doc_id").filter(F.contains("content", "question")).select("task_id", "doc_id")
    short = asked.join(inner.select("task_id").distinct(), "task_id", "left_anti").select("task_id", "question")
    return found.unionByName(occurrences(short, docs))


def occurrences(questions: DataFrame, docs: DataFrame) -> DataFrame:
    """task_id, doc_id of all ``questions`` (task_id, question) that documents (doc_id, content) hold, at any place. Different questions are numbered and
    dealt into blocks, each an automaton that tasks build once; a block is one pass over the documents, whatever it finds, and equal
    questions are looked for once."""
    spark = docs.sparkSession
    texts = stored(questions.select("question").distinct().withColumn("number", F.monotonically_increasing_id()))
    n, chars = texts.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("question")), F.lit(0))).first()
    blocks = max(-(-n // SHORT_QUESTIONS), -(-chars // SHORT_CHARS))
    found = None
    for block in range(blocks):
        mine = [(r["number"], r["question"]) for r in texts.filter(F.pmod(F.xxhash64("number"), F.lit(blocks)) == block).collect()]
        made = docs.select("doc_id", "content").mapInPandas(_holds(mine), StructType([docs.schema["doc_id"], StructField("number", LongType())]))
        found = made if found is None else found.unionByName(made)
    if found is None:
        found = spark.createDataFrame([], StructType([docs.schema["doc_id"], StructField("number", LongType())]))
    return questions.join(texts, "question").join(found, "number").select("task_id", "doc_id").distinct()


def _holds(questions: list[tuple[int, str]]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for number, question in questions:
            automaton.add_word(question, number)
        if questions:
            automaton.make_automaton()
        for b in batches:
            hits = [(d, n) for d, text in zip(b["doc_id"], b["content"], strict=True) if text and questions for n in {number for _, number in automaton.iter(text)}]
            yield pd.DataFrame(hits, columns=["doc_id", "number"])

    return run


def run_violations(runs: DataFrame) -> DataFrame:
    """Rules of nested runs (see ``runs.RUN_RECORD``): totals add up, calls by type add up, snippets runs have no trace, ordinals count up."""
    t = F.col("token_accounting")
    by = F.col("tool_calls_by_type")
    ordinals = F.transform("tool_trace", lambda x: x["call_ordinal"])
    own = {
        "token_total": t["total_tokens_estimated"] != t["input_tokens_estimated"] + t["output_tokens_estimated"],
        "token_limit": t["total_tokens_estimated"] > t["limit"],
        "calls_by_type": by["grep"] + by["read"] + by["cat"] + by["list"] != F.col("tool_call_count"),
        "snippets_without_trace": (F.col("condition") == "snippets") & (F.size("tool_trace") > 0),
        "ordinals": (F.size("tool_trace") > 0) & (ordinals != F.sequence(F.lit(1), F.size("tool_trace"))),
    }
    return reduce(DataFrame.unionByName, [
        _rules(runs, "run_key", own),
        duplicates(runs, "run_key", "run_key_unique"),
    ])
