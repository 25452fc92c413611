"""Language-model scores, language ID and packing against plain computations."""

import collections
import itertools
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import common, hmm, langid, packing

LONG = "der die das und nicht " * 900
TEXTS = ["The cat sat on the mat", "the dog sat", None, "", "ÉCOLE École école", LONG, "x\x1cy\u00a0z <|endoftext|> tail", "the cat", "the cat"]
SCHEMA = "doc_id long, text string, score string, lang string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i if i != 4 else None, t, "x", "en") for i, t in enumerate(TEXTS)], SCHEMA)


def small_model(states=3, size=7, seed=0):
    rng = np.random.default_rng(seed)
    share = lambda *s: (x := rng.random(s)) / x.sum(axis=-1, keepdims=True)
    return hmm.Model(share(states), share(states, states), np.ascontiguousarray(share(states, size).T))


def path_probability(m, words):
    total = 0.0
    for path in itertools.product(range(len(m.start)), repeat=len(words)):
        p = m.start[path[0]] * m.emit[words[0], path[0]]
        for t in range(1, len(words)):
            p *= m.move[path[t - 1], path[t]] * m.emit[words[t], path[t]]
        total += p
    return total


def test_forward_sums_over_all_paths():
    m = small_model()
    texts = [np.array(t, dtype=np.uint16) for t in ([0], [1, 2, 3], [6, 6, 0, 1, 2], [5, 4])]
    assert hmm.forward(m, texts) == pytest.approx([math.log(path_probability(m, t)) for t in texts])
    assert sum(math.exp(hmm.forward(m, [np.array(w)])[0]) for w in itertools.product(range(7), repeat=3)) == pytest.approx(1)
    assert len(hmm.forward(m, [])) == 0


def test_expected_counts_are_those_of_the_paths():
    m = small_model(2, 3)
    texts = [[0, 1, 2, 1], [2, 0]]
    table, lengths = np.array([[0, 1, 2, 1], [2, 0, 0, 0]]), np.array([4, 2])
    start, moves, emitted = np.zeros(2), np.zeros((2, 2)), np.zeros((2, 3))
    for t in texts:
        whole = path_probability(m, t)
        for path in itertools.product(range(2), repeat=len(t)):
            p = m.start[path[0]] * m.emit[t[0], path[0]]
            for k in range(1, len(t)):
                p *= m.move[path[k - 1], path[k]] * m.emit[t[k], path[k]]
            p /= whole
            start[path[0]] += p
            for k, s in enumerate(path):
                emitted[s, t[k]] += p
                if k:
                    moves[path[k - 1], s] += p
    got = hmm.expected_counts(m, hmm.Segments(table, lengths, lengths, 0))
    assert got[0] == pytest.approx(start) and got[1] == pytest.approx(moves) and got[2] == pytest.approx(emitted)


def test_segments_count_what_whole_texts_do(monkeypatch):
    m = small_model(3, 7)
    rng = np.random.default_rng(5)
    texts = [rng.integers(0, 7, n).astype(np.uint16) for n in (1, 5, 64, 65, 100, 128, 333, 0)]
    total = lambda: [sum(x) for x in zip(*(hmm.expected_counts(m, g) for g in hmm.in_segments(texts)), strict=True)]
    whole = total()  # all shorter than a segment
    monkeypatch.setattr(hmm, "SEGMENT", 64)
    got = total()
    assert got[0] == pytest.approx(whole[0]) and got[0].sum() == pytest.approx(7)
    assert got[1] == pytest.approx(whole[1], rel=1e-6) and got[1].sum() == pytest.approx(sum(max(0, len(t) - 1) for t in texts))
    assert got[2] == pytest.approx(whole[2], rel=1e-6) and got[2].sum() == pytest.approx(sum(map(len, texts)))


def test_training_raises_the_likelihood():
    rng = np.random.default_rng(3)
    texts = [np.array(rng.permutation(20) % (5 if k % 2 else 20), dtype=np.uint16) for k in range(60)]
    shares = np.full(20, 0.05)
    first, later = (hmm.first_model(texts, 20, shares, 3, rounds, 1) for rounds in (1, 8))
    assert hmm.forward(later, texts).sum() > hmm.forward(first, texts).sum()


def test_scores(docs):
    held = F.coalesce(F.col("doc_id"), F.lit(1)) % 4 == 0
    got = {r["doc_id"]: r for r in hmm.score_documents(docs, held, states=2, rounds=1).collect()}
    assert len(got) == len(TEXTS)
    train = collections.Counter()
    for i, t in enumerate(TEXTS):
        if (i if i != 4 else 1) % 4:
            train.update(hmm.tokens(t))
    n, v = sum(train.values()), len(train)
    for i, t in enumerate(TEXTS):
        r = got[i if i != 4 else None]
        words = hmm.tokens(t)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(words), sum(train[w] > 0 for w in words), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words))
        assert r["score"] < 0 and math.isfinite(r["score"])


def test_words_that_workers_hold_change_no_result(spark, docs):
    held = F.coalesce(F.col("doc_id"), F.lit(1)) % 4 == 0
    few, many = (sorted(map(tuple, hmm.score_documents(docs, held, states=2, rounds=1, top_words=2, held_words=k).collect()), key=repr) for k in (2, 1000))
    assert len(few) == len(many) and all(a[:5] == b[:5] and a[5:] == pytest.approx(b[5:]) for a, b in zip(few, many, strict=True))
    with pytest.raises(ValueError):
        hmm.score_documents(docs, held, top_words=1 << 16)


def test_all_words_share_one_probability(spark, monkeypatch):
    """With one state a text's probability is a product over its words: it is computed here from the counts, and the shares of all
    known words and one unknown word a class add to 1."""
    monkeypatch.setattr(hmm, "TOP", 2)
    monkeypatch.setattr(hmm, "KNOWN", 4)
    rows = [(1, "a a a a b b b bb cc cc dd ee ee ff"), (3, "a b cc gg hh"), (2, "a b bb cc dd ee ff gg hh nn"), (-1, "")]
    train = collections.Counter(hmm.tokens(rows[0][1]) + hmm.tokens(rows[1][1]))
    one_each: dict[int, str] = {}
    for w in [*map("".join, itertools.product("abcdefghijklmnopqrstuvwxyz0123456789", repeat=3)), *("x" + chr(k) for k in range(0x80, 0x10000) if not 0xD800 <= k < 0xE000)]:
        one_each.setdefault(hmm.word_class(w.encode()), w)
    assert len(one_each) == hmm.CLASSES
    words = [w.decode() for w in train if w != hmm.END] + sorted(one_each.values())
    docs = spark.createDataFrame(rows + [(1000 + i, w) for i, w in enumerate(words)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in hmm.score_documents(docs, ~F.col("doc_id").isin(1, 3), states=1, rounds=1).collect()}
    assert got[2]["n_known"] == 10 and got[2]["n_tokens"] == 11
    n, v = sum(train.values()), len(train)
    assert got[2]["base_score"] == pytest.approx(sum(math.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in hmm.tokens(rows[2][1])))
    end = 10 ** got[-1]["score"]
    assert sum(10 ** got[1000 + i]["score"] for i in range(len(words))) + end * end == pytest.approx(end)
    # the words with emissions of their own, then classes; counts plus the prior over overall shares
    own = [hmm.END, *sorted((w for w in train if w != hmm.END), key=lambda w: -train[w])[:2]]
    in_class = collections.Counter()
    for w, c in train.items():
        if w not in own:
            in_class[hmm.word_class(w)] += c
    share = {w: train[w] + 0.1 for w in own} | {k: in_class[k] + 0.1 for k in range(hmm.CLASSES)}
    scale = sum(share.values())
    emit = {k: ((train[k] if k in own else in_class[k]) + hmm.EMISSION_PRIOR * x / scale) / (n + hmm.EMISSION_PRIOR) for k, x in share.items()}
    rare = [c for w, c in train.items() if w not in own]
    discount = min(0.9, max(0.1, rare.count(1) / (rare.count(1) + 2 * rare.count(2))))

    def p(w):
        k = hmm.word_class(w)
        if w in own:
            return emit[w]
        left = discount * sum(x not in own and hmm.word_class(x) == k for x in train) / in_class[k] if in_class[k] else 1.0
        return emit[k] * ((train[w] - discount) / in_class[k] if train[w] else left)

    assert got[2]["score"] == pytest.approx(sum(math.log10(p(w)) for w in hmm.tokens(rows[2][1])))


def test_scores_without_training_or_rows(spark, docs):
    got = hmm.score_documents(docs, F.lit(True), states=2).collect()
    assert all(r["n_known"] == 0 and r["train_tokens"] == 0 for r in got) and len(got) == len(TEXTS)
    assert hmm.score_documents(docs.limit(0), F.lit(False)).count() == 0


def language_rows():
    rng = np.random.default_rng(0)
    words = {"en": "the and of was with that hatten".split(), "de": "der und nicht schön über keit ein".split(), "es": "el los que ción año más para".split()}
    rows = []
    for i in range(240):
        lang = ("en", "de", "es")[i % 3]
        rows.append((i, " ".join(rng.choice(words[lang], size=rng.integers(5, 60))), lang, "s"))
    return rows


def test_languages_are_told(spark):
    docs = spark.createDataFrame(language_rows(), "doc_id long, text string, lang string, score string")
    held = common.crc32_text(F.col("doc_id")) % 4 == 2
    model = langid.fit(docs, ~held)
    got = langid.identify(docs, model).filter(held).collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in got]) > 0.97 and all(0 <= r["score"] <= 1 for r in got)
    assert np.mean([r["accepted"] for r in got]) > 0.97


def invented(rng, words: list[str], n: int) -> list[str]:
    return [" ".join(rng.choice(words, size=rng.integers(3, 80))) for _ in range(n)]


def test_unlearnt_languages_and_noise_are_rejected(spark):
    """Four languages over one alphabet, each with its own syllables; the last is not learnt."""
    rng = np.random.default_rng(12)
    syllables = [[a + b for a in rng.permutation(list("bcdfghklmnprstvz"))[:8] for b in rng.permutation(list("aeiou"))[:3]] for _ in range(4)]
    lexica = [["".join(rng.choice(s, size=rng.integers(1, 4))) for _ in range(300)] for s in syllables]
    texts = [(i, t, f"l{k}") for k in range(3) for i, t in enumerate(invented(rng, lexica[k], 900), 1000 * k)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    model = langid.fit(docs, F.col("doc_id") % 1000 < 800, per_language=800)
    known = [t for i, t, _ in texts if i % 1000 >= 800]
    foreign = [t for t in invented(rng, lexica[3], 100) if len(t) >= 128]
    mixed = [langid.noise(t, rng) for t in known if len(t) >= 128]
    cyrillic = ["".join(chr(0x430 + x) if x < 32 else " " for x in rng.integers(0, 38, 200)) for _ in range(50)]
    share = lambda ts: np.mean([model.predict(t)[2] for t in ts])
    assert share(known) > 0.98 and share(foreign) < 0.2 and share(mixed) < 0.05 and share(cyrillic) < 0.1
    assert np.mean([model.predict(t)[0] == y for i, t, y in texts if i % 1000 >= 800]) > 0.98


def test_copies_count_once_in_the_sample(spark):
    rows = language_rows()
    once = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    often = once.union(spark.createDataFrame([rows[0]] * 2000, once.schema))
    a, b = (langid.fit(x, F.lit(True), per_language=60) for x in (once, often))
    assert (a.table == b.table).all() and a.cuts == b.cuts and a.temperature == b.temperature


def test_letterless_texts(spark):
    docs = spark.createDataFrame(language_rows(), "doc_id long, text string, lang string, score string")
    model = langid.fit(docs, F.lit(True))
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 _ 456 ½ ²"), (4, "ß"), (5, LONG * 3)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in langid.identify(odd, model).collect()}
    assert [got[k]["lang_pred"] for k in (1, 2, 3)] == ["und"] * 3 and not any(got[k]["accepted"] for k in (1, 2, 3))
    assert got[4]["lang_pred"] in model.labels and got[5]["lang_pred"] == "de"
    assert langid.identify(odd.limit(0), model).count() == 0
    nothing = langid.fit(odd.withColumn("lang", F.lit(None).cast("string")), F.lit(True))
    assert {r["lang_pred"] for r in langid.identify(odd, nothing).collect()} == {"und"}


def test_subwords_do_not_depend_on_portions(monkeypatch):
    text = LONG[:1000].encode()
    whole = np.sort(np.concatenate(list(langid.subwords(text))))
    monkeypatch.setattr(langid, "PORTION", 37)
    assert (np.sort(np.concatenate(list(langid.subwords(text)))) == whole).all()


def reference_ids(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(text or "", add_special_tokens=False).ids, 2]


def test_ids_are_those_of_the_other_library():
    """Over all texts of a table, which hold junk, several scripts and long runs."""
    import public_tokenizers
    import pyarrow.parquet as pq
    from tokenizers import Tokenizer

    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()]
    want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode_batch(texts, add_special_tokens=False)
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    assert all(packing.token_ids(t, path).tolist() == w.ids for t, w in zip(texts, want, strict=True))


def test_the_best_pair_may_be_of_two_small_ones():
    plan = packing.best_two_fit({900: 1, 600: 1, 490: 2, 100: 1}, 1000)
    fill = collections.defaultdict(list)
    for length, first, last, sequence, _, run in plan:
        for k in range(last - first):
            fill[sequence + k // run].append(length)
    assert sorted(map(sorted, fill.values())) == [[100, 900], [490, 490], [600]]


def test_packing_round_trip(docs):
    got = collections.defaultdict(list)
    sequences = collections.defaultdict(list)
    for r in packing.pack(docs, capacity=64).collect():
        got[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, t in enumerate(TEXTS):
        ids, at = reference_ids(t), 0
        for k, r in enumerate(sorted(got[i if i != 4 else None], key=lambda r: r["piece"])):
            part = np.array(ids[at : at + r["length"]], dtype="<u4")
            assert (r["piece"], r["start"], r["ids_crc32"]) == (k, at, zlib.crc32(part.tobytes()))
            assert r["length"] == 64 or k == 0
            at += r["length"]
        assert at == len(ids)
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64


def plain_best_two_fit(lengths, capacity):
    left = sorted(lengths, reverse=True)
    out = []
    while left:
        bin_, gap = [], capacity
        for x in list(left):
            if x <= gap:
                bin_.append(x)
                left.remove(x)
                gap -= x
        if gap and bin_:
            small = bin_[-1]
            pool = sorted([*left, small])
            pairs = [(a + b, a, b) for i, a in enumerate(pool) for b in pool[:i] if a + b <= gap + small]
            if pairs and max(pairs)[0] > small:
                _, a, b = max(pairs)
                bin_.pop()
                left.append(small)
                for x in (a, b):
                    bin_.append(x)
                    left.remove(x)
                left.sort(reverse=True)
        out.append(sum(bin_))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_plan_fills_as_well_as_one_by_one(seed):
    rng = np.random.default_rng(seed)
    lengths = np.minimum(rng.geometric(0.02, size=300), 100).tolist()
    plan = packing.best_two_fit(dict(collections.Counter(lengths)), 100)
    used = collections.Counter()
    fill = collections.defaultdict(list)
    for length, first, last, sequence, offset, run in plan:
        assert first == used[length]
        used[length] = last
        for k in range(last - first):
            fill[sequence + k // run].append((offset + k % run * length, length))
    assert used == collections.Counter(lengths)
    for places in fill.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 100
    assert len(fill) <= len(plain_best_two_fit(lengths, 100)) + 1


def test_plan_does_not_grow_with_the_counts():
    few = packing.best_two_fit({k: 50 for k in range(1, 101)}, 100)
    many = packing.best_two_fit({k: 50_000_000 for k in range(1, 101)}, 100)
    assert len(many) <= 2 * len(few) + 200
    assert packing.best_two_fit({}, 100) == []
    with pytest.raises(ValueError):
        packing.best_two_fit({101: 1}, 100)


def test_packing_nothing(docs):
    assert packing.pack(docs.limit(0)).count() == 0


def test_rows_of_a_null_id_are_numbered_in_ranges(spark):
    docs = spark.createDataFrame([(None, f"w{i}") for i in range(200)] + [(None, "same")] * 300 + [(1, None), (None, None)] * 50, "doc_id long, text string")
    made = packing.pack(docs).collect()
    assert len(made) == 600
    places = {(r["sequence_id"], r["offset"]) for r in made}
    assert len(places) == 600
    held = collections.Counter()
    for r in made:
        held[r["sequence_id"]] += r["length"]
    assert all(sorted(r["offset"] for r in made if r["sequence_id"] == q)[0] == 0 and n <= 1024 for q, n in held.items())


def test_training_segments_are_small():
    """The driver holds the buckets and counts of all training segments."""
    buckets, counts = langid._features(b"the quick brown fox " * 12)
    assert buckets.nbytes + counts.nbytes <= 4 * len(buckets)
    assert counts.sum() == sum(len(ids) for ids in langid.subwords(b"the quick brown fox " * 12))
