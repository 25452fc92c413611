"""Search over bit slices against plain sums, on made-up and given texts."""

import collections
import math
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.llm import bitsliced, common

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=10):
    counts = [(i, collections.Counter(terms(t))) for i, t in docs]
    n = sum(bool(c) for _, c in counts)
    length = sum(c.total() for _, c in counts)
    df = collections.Counter(t for _, c in counts for t in c)
    out = []
    for item, text in {(i, t) for i, t in items if t is not None}:
        found = []
        for doc, c in counts:
            score = 0
            for t in terms(text):
                if c[t]:
                    m = 25 + (75 * c.total() * n) // length
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
            if score > 0:
                found.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank, f[3], -f[0]) for rank, f in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def searched(spark, docs, items, k=10):
    made = bitsliced.search(bitsliced.build_index(docs), items, k)
    return sorted((tuple(r) for r in made.collect()), key=str)


@pytest.mark.parametrize(("rows", "size"), [(1 << 12, 1 << 23), (7, 1 << 23), (50, 200)])
def test_random_texts(spark, monkeypatch, rows, size):
    monkeypatch.setattr(bitsliced, "BLOCK_ROWS", rows)
    monkeypatch.setattr(bitsliced, "BLOCK_BYTES", size)
    rng = random.Random(rows)
    words = [f"w{i}" for i in range(30)] + ["É", "naïve", "A1", "中文"]
    line = lambda n: rng.choice(" ,-") .join(rng.choices(words, [1 / (i + 1) for i in range(len(words))], k=rng.randrange(n)))
    docs = [(i, line(60)) for i in range(150)]
    items = [(i, line(12)) for i in range(25)] + [(99, "w0 " * 300), (98, "nowhere")]
    got = searched(spark, spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"))
    assert got == brute(docs, items)


def test_odd_rows(spark):
    long = "alpha beta " * 30_000
    docs = [(1, "alpha"), (2, None), (3, ""), (None, "alpha beta"), (5, long), (5, long), (6, "ALPHA. alpha-Beta\x00"), (7, "?!"), (8, "gamma"), (1, "alpha"), (None, "alpha beta")]
    items = [(1, "alpha beta"), (1, "alpha beta"), (1, "gamma"), (2, None), (3, ""), (None, "beta"), (4, "delta")]
    wide = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, term string, block int")
    asked = spark.createDataFrame([(*i, "y") for i in items], "item_id long, text string, query string")
    assert searched(spark, wide, asked) == brute(docs, items)
    assert [r for r in searched(spark, wide, asked, 2) if r[0] == 1] == [r for r in brute(docs, items, 2) if r[0] == 1]


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "alpha")], "item_id long, text string")
    assert searched(spark, docs, some) == searched(spark, docs, items) == []
    assert searched(spark, spark.createDataFrame([(1, "!"), (2, None)], "doc_id long, text string"), some) == []
    assert searched(spark, spark.createDataFrame([(1, "alpha")], "doc_id long, text string"), items) == []


def test_many_groups_of_queries(spark, monkeypatch, sf_dir):
    docs, items = common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "benchmark")
    index = bitsliced.build_index(docs)
    whole = sorted(map(tuple, bitsliced.search(index, items).collect()))
    monkeypatch.setattr(bitsliced, "GROUP_TERMS", 400)
    monkeypatch.setattr(bitsliced, "TOGETHER", 3)
    assert sorted(map(tuple, bitsliced.search(index, items).collect())) == whole
    assert whole == sorted(brute([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.select("item_id", "text").collect()]))


def test_no_stored_row_grows_with_a_block(spark, monkeypatch):
    """Readers gather thousands of rows at once, so a row of a stored table may hold a term's documents of a block, or its doc_ids, but not its texts."""
    written = []
    monkeypatch.setattr(bitsliced, "stored", lambda df: written.append(common.stored(df)) or written[-1])
    docs = spark.range(4000).selectExpr("id AS doc_id", "array_join(transform(sequence(1, 40), k -> concat('w', pmod(hash(id, k), 5000))), ' ') AS text")
    bitsliced.build_index(docs.coalesce(1))
    sizes = [df.select(F.length(F.to_json(F.struct(*df.columns))).alias("n")).agg(F.max("n")).first()[0] for df in written]
    assert sizes and max(sizes) < 1 << 16


def slices_of(numbers, count, width=64):
    out = np.zeros((count, numbers.shape[0], width // 8), np.uint8)
    for s in range(count):
        bits = np.zeros((numbers.shape[0], width), np.uint8)
        bits[:, : numbers.shape[1]] = numbers >> s & 1
        out[s] = np.packbits(bits, axis=1, bitorder="little")
    return out.view(np.uint64)


def numbers_of(slices, n):
    flat = np.unpackbits(slices.view(np.uint8), axis=-1, bitorder="little")[..., :n].astype(np.int64)
    return sum(flat[s] << s for s in range(len(flat)))


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 2**32 - 1))
def test_sums_products_and_the_best(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 64))
    a, b = rng.integers(0, 1 << 20, (2, 3, n))
    total = slices_of(a, 22)
    bitsliced.add_into(total, slices_of(b, 20))
    assert (numbers_of(total, n) == a + b).all()
    weight = rng.integers(0, 5000, (3, 1))
    worth = bitsliced.weighted(slices_of(a, 20).view(np.uint8).reshape(20, -1), np.repeat(weight, 8))
    assert (numbers_of(worth.reshape(len(worth), 3, 8), n) == a * weight).all()
    ties = rng.integers(0, 6, (3, n))
    k = int(rng.integers(1, 12))
    chosen = bitsliced.top(slices_of(ties, 3), k)
    for row, take in zip(ties, chosen, strict=True):
        want = sorted((-v, i) for i, v in enumerate(row.tolist()) if v)[:k]
        assert np.flatnonzero(take).tolist() == sorted(i for _, i in want)
