"""Documents to packed training sequences, in five stages; each stage's rows are written and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import common, langid, mixing, packing, paragraphs, simhash

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


# What all stages have in common: they take documents with COLUMNS, leave out all other columns, return COLUMNS (but the last),
# give no rows for an empty table, and read whole texts of any length, each held whole by the task that works on it.


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told as surely as held-out text of known languages is. Null and empty texts and those without a
    letter go, and so do noise and languages that no row names. Rows with a null lang are judged but teach nothing; repeated rows
    are judged alike, and all stay or go."""
    docs = docs.select(COLUMNS)
    model = langid.fit(docs, F.lit(True))
    return langid.identify(docs, model).filter("accepted").select(COLUMNS)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: texts whose 5-word shingles have a Jaccard similarity of 0.8 or more. Of a class the
    row with the least doc_id stays (a null one comes last, ties go by a digest of doc_id and text); of rows that agree in doc_id and
    text, one. Null, empty and wordless texts are copies of each other. Candidates are texts with near fingerprints and, as 64
    bits miss most pairs at 0.8, texts that share a MinHash band; all are verified."""
    return simhash.one_of_each(docs.select(COLUMNS))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that stand earlier in the corpus (by doc_id, then place, then a digest; null ids last):
    paragraphs of 20 words or more that are near another, and runs of 51 words or more that stand elsewhere too. Null texts stay
    null, empty ones empty; n_chars is that of what is left (null for null). Rows that agree in doc_id and text are cut alike."""
    cut = paragraphs.without_repeats(docs.select(COLUMNS))
    return cut.withColumn("n_chars", F.length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them: all once, those of small sources up to twice. A null source is a source;
    documents without words come once; repeated rows come each as often as their record does."""
    return mixing.mixed_documents(docs.select(COLUMNS))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences of 1024 tokens. Null and empty texts are the end mark alone; repeated rows are
    packed each; of ties in length any may come first, in an order that doc_id, piece and content decide."""
    return packing.pack(docs.select(COLUMNS))


STAGES = [
    ("language_id", language_id),
    ("simhash_dedup", simhash_dedup),
    ("substring_dedup", substring_dedup),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

#: Trained models, fingerprints and tokens have no counterpart in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over the documents of ``sf_dir``. A stage's tables in the shared folder go when its result is
    written, and that goes when the next one is."""
    docs = common.read(spark, sf_dir, "documents")
    with common.scratch(keep=1):
        for _, stage in STAGES[:-1]:
            with common.scratch(keep=1):
                docs = common.stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
