"""The pipeline's stages on a small corpus whose right results are known."""

import collections

import numpy as np
import pytest

import corpus_pipeline
from textloom.llm import common

WORDS = {"en": "the and of was with that this from which", "de": "der und nicht schön über keit ein auch wird"}


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = np.random.default_rng(8)
    say = lambda lang, n: " ".join(f"{rng.choice(WORDS[lang].split())}{x if x % 3 else ''}" for x in rng.integers(0, 900, size=n))
    rows = [(i, say("en" if i % 3 else "de", int(rng.integers(40, 160))), "en" if i % 3 else "de", "big" if i % 4 else "small") for i in range(200)]
    passage = say("en", 60)
    rows += [(500, rows[1][1], "en", "big"), (501, rows[1][1] + " tail", "en", "small"), (502, say("en", 70) + " " + passage, "en", "big"), (503, passage + "\n" + say("en", 90), "en", "big"), (504, None, "en", "big"), (505, "123 456", "en", "big"), (506, "", None, None)]
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    return folder


def test_stages(spark, sf_dir):
    docs = common.read(spark, sf_dir, "documents")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "simhash_dedup", "substring_dedup", "mix_sources", "pack_sequences"]
    told = common.stored(stages["language_id"](spark, docs, sf_dir))
    ids = {r["doc_id"] for r in told.collect()}
    assert ids >= set(range(200)) | {500, 501, 502, 503} and not ids & {504, 505, 506} and told.columns == docs.columns
    once = common.stored(stages["simhash_dedup"](spark, told, sf_dir))
    left = {r["doc_id"] for r in once.collect()}
    assert 1 in left and 500 not in left and {502, 503} <= left and set(range(200)) - left == set() and once.columns == docs.columns
    cut = common.stored(stages["substring_dedup"](spark, once, sf_dir))
    texts = {r["doc_id"]: r for r in cut.collect()}
    before = {r["doc_id"]: r["text"] for r in once.collect()}
    assert set(texts) == left and texts[502]["text"] == before[502] and len(texts[503]["text"]) < len(before[503]) and texts[503]["n_chars"] == len(texts[503]["text"])
    assert all(texts[i]["text"] == before[i] for i in range(200) if i != 1)
    mixed = common.stored(stages["mix_sources"](spark, cut, sf_dir))
    n = collections.Counter(r["doc_id"] for r in mixed.collect())
    assert set(n) == left and max(n.values()) == 2 and all(n[i] == 1 for i in left if texts[i]["source"] == "big") and mixed.columns == docs.columns
    packed = stages["pack_sequences"](spark, mixed, sf_dir).collect()
    assert {r["doc_id"] for r in packed} == left
    fill = collections.Counter()
    for r in packed:
        fill[r["sequence_id"]] += r["length"]
    assert max(fill.values()) <= 1024 and len(fill) <= -(-sum(fill.values()) // 1024) * 1.02 + 1


def test_run_is_its_stages(spark, sf_dir):
    docs = common.read(spark, sf_dir, "documents")
    for _, stage in corpus_pipeline.STAGES:
        docs = common.stored(stage(spark, docs, sf_dir))
    key = lambda df: collections.Counter((r["doc_id"], r["piece"], r["ids_crc32"]) for r in df.collect())
    assert key(corpus_pipeline.run(spark, sf_dir)) == key(docs)


def test_an_empty_corpus(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_copies_down_to_the_similarity_go(spark):
    rng = np.random.default_rng(12)
    rows, near, far, sim = [], set(), set(), lambda a, b: len(a & b) / len(a | b)
    cut = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    for i in range(60):
        words = [f"n{x}" for x in rng.integers(0, 5000, size=200)]
        edited = list(words)
        for k in rng.choice(196, size=1 + i % 9, replace=False):
            edited[k + 2] = f"e{i}x{k}"
        (near if (s := sim(cut(words), cut(edited))) >= 0.8 else far).add(1000 + i)
        rows += [(i, " ".join(words)), (1000 + i, " ".join(edited))]
    rows += [(2000, "one two"), (2001, "One  two"), (2002, "one three"), (2003, None), (2004, " "), (2000, "one two"), (None, "one two"), (None, "alone here")]
    docs = spark.createDataFrame([(i, t, "en", "x", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = [r["doc_id"] for r in corpus_pipeline.simhash_dedup(spark, docs, "").collect()]
    assert len(left) == len(set(left)) and set(range(60)) | far | {2000, 2002, 2003, None} <= set(left) and not {2001, 2004} & set(left)
    assert len(near) >= 20 and len(far) >= 10 and len(near & set(left)) <= 1
