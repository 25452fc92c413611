import unicodedata

import pytest
from pyspark.sql import functions as F

from textloom.functions import text as T

ODD = ["Ｆoo STRAẞE café", "it's a co-op - don't", "a_b 1.5", "x\u2028y\x0bz\r\nq\n", "", "fi ﬁ ½", "ΑΣ\u00a0Σ", "naïve 'quoted' ''", None]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(list(enumerate(ODD)), "id int, text string")


def rows(df):
    return [r[1] for r in df.orderBy("id").collect()]


def test_terms_match_python(odd):
    got = rows(odd.select("id", T.terms(F.col("text"), exact=True)))
    import re

    want = [None if t is None else re.findall(r"[^\W_]+(?:['-][^\W_]+)*", unicodedata.normalize("NFKC", t).casefold()) for t in ODD]
    assert got == want
    assert got[0] == ["foo", "strasse", "café"]


def test_token_counts_match_python(odd):
    got = rows(odd.select("id", T.count_tokens(F.col("text"), exact=True)))
    assert got == [None if t is None else len(T._PY_TOKEN.findall(T.fold(t))) for t in ODD]


def test_lines_are_those_of_splitlines(odd):
    assert rows(odd.select("id", T.lines(F.col("text")))) == [None if t is None else t.splitlines() for t in ODD]


def test_normal_answer(spark):
    got = spark.range(1).select(T.normal_answer(F.lit("  ＹＥＳ\t\nrequired?!  "), exact=True)).first()[0]
    assert got == "yes required"


def test_truncation_ends_with_a_token_and_fits():
    assert T.cut_to_tokens("one, two three", 3) == "one, two"
    assert T.cut_to_tokens("one", 5) == "one"
    assert T.cut_to_tokens("one", 0) == ""
    cut = T.cut_to_tokens("½ ½ ½ tail", 4)
    assert "½ ½ ½ tail".startswith(cut) and len(T._PY_TOKEN.findall(T.fold(cut))) <= 4


def test_child_seed_is_the_digests_start(spark):
    import hashlib

    want = int.from_bytes(hashlib.sha256(b"42:task:7").digest()[:8], "big")
    assert int(spark.range(1).select(T.child_seed(F.lit(42), F.lit("task"), F.lit(7))).first()[0]) == want


def test_messages_count_as_their_json(spark):
    from textloom.operators.budget import request_tokens

    messages = [{"role": "user", "content": 'say "hi"\n'}, {"role": "assistant", "content": None}]
    columns = [T.canonical_message(F.lit(m["role"]), F.lit(m["content"]).cast("string")) for m in messages]
    assert spark.range(1).select(T.count_messages(F.array(*columns))).first()[0] == request_tokens(messages)
