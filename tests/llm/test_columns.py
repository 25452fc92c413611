"""Rows with nulls everywhere and columns whose names the operators use themselves."""

import pytest
from pyspark.sql import functions as F

from textloom.llm import embeddings, hmm, langid, mixing, packing, paragraphs, quality, sharding, simhash, urls

NAMES = ["row_key", "key", "node", "fp", "tokens", "score", "kept", "shard", "slot", "_digest", "epoch", "block", "component", "component_id", "length", "start", "end", "window", "held_out", "n_words", "lang_pred", "accepted", "two", "host", "path", "stack", "copies", "links", "first", "n", "g", "c", "row", "cut", "record_key", "told", "doc", "text_", "keys", "least", "part", "__row", "__row_key", "__cut", "__record_key", "__told", "near"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, "some text of a few words here", "en", "s"), (None, None, None, None), (2, None, "en", None), (None, "alone", None, "s"), (3, "word " * 300, "de", "s"), (3, "word " * 300, "de", "s"), (4, "some text of a few words here", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return docs.select("*", *(F.lit("extra").alias(c) for c in NAMES))


def test_reports_have_a_row_each(odd):
    n = odd.count()
    model = langid.fit(odd, F.lit(True))
    for df in (hmm.score_documents(odd, F.col("doc_id") == 1, states=2, rounds=1), quality.judge_quality(odd), sharding.shard_documents(odd, [1.0, 1.0]), simhash.near_duplicates(odd), langid.identify(odd, model)):
        assert df.count() == n
    assert packing.pack(odd).select("doc_id", "piece", "sequence_id", "offset").distinct().count() == n
    assert mixing.mix(odd).agg(F.sum("copies")).first()[0] >= n
    assert {r["doc_id"] for r in paragraphs.repeated_passages(odd).collect()} <= {3}


def test_filters_keep_all_columns(odd):
    model = langid.fit(odd, F.lit(True))
    told = langid.identify(odd, model)
    assert set(told.columns) == set(odd.columns) | {"lang_pred", "score", "accepted"}
    for df in (simhash.one_of_each(odd), paragraphs.without_repeats(odd), mixing.mixed_documents(odd)):
        assert df.columns == odd.columns and df.count() > 0
        assert df.select("row_key", "key", "kept").distinct().collect()[0][:] == ("extra",) * 3


def test_pages_and_vectors(spark):
    extra = [F.lit("extra").alias(c) for c in NAMES]
    pages = spark.createDataFrame([(None, None), (1, "http://a.com/en/"), (1, "http://a.com/en/"), (2, None)], "page_id long, url string").select("*", *extra)
    rules = spark.createDataFrame([("block", "a.com", "/en/"), ("block", "a.com", "/en/"), (None, None, None)], "action string, host string, path string")
    got = sorted(((r["page_id"] or 0, r["verdict"]) for r in urls.judge_urls(pages, rules).collect()))
    assert got == [(0, "allow"), (1, "block"), (1, "block"), (2, "allow")]
    vectors = spark.createDataFrame([(None, [1.0, 2.0]), (1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None)], "vec_id long, embedding array<float>").select("*", *extra)
    got = sorted(((r["vec_id"] or 0, r["n_links"]) for r in embeddings.similar_vectors(vectors).collect()))
    assert got == [(0, 0), (1, 1), (1, 1), (2, 0)]
