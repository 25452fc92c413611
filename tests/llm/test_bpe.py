"""Byte-level BPE against tiktoken: slices, merges, offsets, decoding."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from textloom.llm import bpe, common, queries

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def plain():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoded(texts):
    ids, ends, stops = bpe.merger(PATH).encode(texts)
    return [(ids[a:b].tolist(), stops[a:b].tolist()) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def same(plain, texts):
    for text, (ids, stops) in zip(texts, encoded(texts), strict=True):
        assert ids == plain.encode_ordinary(text), text[:80]
        assert stops == np.cumsum([len(plain.decode_single_token_bytes(i)) for i in ids]).tolist()


def test_functions_compose_in_any_grouping():
    f = range(len(bpe.FUNCTIONS))
    for a in f:
        for b in f:
            assert (bpe.FUNCTIONS[bpe.THEN[a, b]] == bpe.FUNCTIONS[b][bpe.FUNCTIONS[a]]).all()
            for c in f:
                assert bpe.THEN[bpe.THEN[a, b], c] == bpe.THEN[a, bpe.THEN[b, c]]


def test_every_code_point(plain):
    same(plain, [f"a{chr(i)}1 {chr(i)}x{chr(i)}" for i in range(0, 0x110000) if not 0xD800 <= i < 0xE000 and (i < 0x3400 or i % 7 == 0)])


@pytest.mark.parametrize("text", ["", " ", "\n", "  \n", "a", "I'll we've don't 'tis ''s 're  \n\n x", "'l", "'", "x's", "end  ", "\x00\x00<|endoftext|>", "ab" * 40_000, "x" * 3000 + "é" * 3000, " " * 3000 + "x", "\t" * 50 + "'ve", "".join(map(chr, range(32, 400)))])
def test_single_texts(plain, text):
    same(plain, [text])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from("aesdtmrvl'' \n\t19é²Ⅷ中　́🙂#.-_\x00\x85"), st.characters(exclude_categories=["Cs"])), max_size=60), max_size=8))
def test_any_texts(plain, texts):
    same(plain, texts)


def test_neighbours_do_not_matter(plain):
    """Whatever texts are laid out beside a text, at whatever width, it has the same slices."""
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab's \n 1.é") for _ in range(rng.randrange(200))) for _ in range(300)]
    same(plain, texts)
    assert [encoded([t])[0] for t in texts] == encoded(texts)


def test_all_texts_of_a_table(spark, plain):
    rows = {r["doc_id"]: r for r in queries.op12_byte_bpe(spark, "/root/testdata/sf0.01").collect()}
    docs = common.read(spark, "/root/testdata/sf0.01", "documents").collect()
    assert len(rows) == len(docs)
    for d in docs:
        ids = plain.encode_ordinary(d["text"] or "")
        want = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((d["text"] or "").encode()).hexdigest())
        assert (rows[d["doc_id"]]["n_tokens"], rows[d["doc_id"]]["ids_sha256"], rows[d["doc_id"]]["decoded_sha256"]) == want


ROWS = [(1, "one two", "k"), (None, None, None), (2, "", "k"), (1, "one two", "k"), (3, "héllo " * 40_000, "k"), (4, "'s", None)]


def test_odd_rows_and_a_stretch_given_back(spark, plain):
    made = bpe.decode(bpe.encode(spark.createDataFrame(ROWS, "doc_id long, text string, decoded_ string"), PATH), PATH).collect()
    assert len(made) == len(ROWS)
    for r, (doc_id, text, other) in zip(made, ROWS, strict=True):
        assert (r["doc_id"], r["decoded_"], bytes(r["decoded"]).decode()) == (doc_id, other, text or "")
        assert r["ids"] == plain.encode_ordinary(text or "")
    r = made[4]
    own = bpe.merger(PATH)
    lo, hi = 101, 517
    from_bytes = ROWS[4][1].encode()[r["stops"][lo - 1] : r["stops"][hi]]
    stops = np.array(r["stops"][lo : hi + 1]) - r["stops"][lo - 1]
    assert own.decode(np.array(r["ids"][lo : hi + 1]), stops).tobytes() == from_bytes


def test_empty_tables_and_clashing_names(spark):
    none = spark.createDataFrame([], "text string, doc_id long")
    assert bpe.decode(bpe.encode(none, PATH), PATH).count() == 0
    with pytest.raises(ValueError, match="ids"):
        bpe.encode(spark.createDataFrame([("a", 1)], "text string, IDS int"), PATH)
