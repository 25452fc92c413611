"""Near-duplicates, links and components against all pairs."""

import collections

import numpy as np
import pytest
import xxhash

from textloom.llm import components, embeddings, paragraphs, simhash, xxh64

SCHEMA = "doc_id long, text string, component_id string, lang string"


def classes(n, linked):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in linked:
        up[max(find(a), find(b))] = min(find(a), find(b))
    return [find(k) for k in range(n)]


@pytest.mark.parametrize("shape", ["path", "star", "random", "none"])
def test_components(spark, shape):
    rng = np.random.default_rng(1)
    edges = {"path": [(k, k + 1) for k in rng.permutation(40).tolist()], "star": [(50, k) for k in range(40)], "random": rng.integers(0, 60, (45, 2)).tolist(), "none": []}[shape]
    df = spark.createDataFrame([(int(a), int(b)) for a, b in edges] * 2 + [(None, 3)], "a long, b long")
    got = {r["node"]: r["component"] for r in components.connected_components(df).collect()}
    want = classes(61, edges)
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: want[x] for x in nodes}


def plain_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def near_texts():
    rng = np.random.default_rng(5)
    rows = []
    for i in range(40):
        words = [f"w{x}" for x in rng.integers(0, 400, size=rng.integers(3, 200))]
        rows.append(" ".join(words))
        if i % 3 == 0 and len(words) > 20:
            words[5] = "changed"
            rows.append(" ".join(words))
            rows.append(rows[-2].upper())
    return [*rows, None, "", " \n", "One", "one", "a b c", "long " * 30_000, "É é"]


def test_simhash_matches_all_pairs(spark):
    texts = near_texts()
    docs = spark.createDataFrame([(100 + i, t, "x", "en") for i, t in enumerate(texts)], SCHEMA)
    prints = [plain_print(t) for t in texts]
    want = classes(len(texts), [(i, j) for i in range(len(texts)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4])
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    assert [got[100 + i]["fingerprint"] for i in range(len(texts))] == [f"{p:016x}" for p in prints]
    assert [got[100 + i]["component_id"] for i in range(len(texts))] == [100 + c for c in want]


def test_digests_of_many_spans():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 9000, dtype=np.uint8).tobytes()
    starts = rng.integers(0, 7000, 600)
    ends = starts + np.concatenate([np.arange(300), rng.integers(0, 2000, 300)])
    for seed in (0, 42):
        assert xxh64.span_digests(data, starts, ends, seed).tolist() == [xxhash.xxh64_intdigest(data[a:b], seed) for a, b in zip(starts, ends, strict=True)]
    assert len(xxh64.span_digests(b"", starts[:0], ends[:0], 1)) == 0


@pytest.mark.parametrize("n,cell,block", [(400, 256, 1 << 13), (3000, 64, 1 << 13), (1200, 64, 40)])
def test_trie_links_lose_no_link(spark, monkeypatch, n, cell, block):
    """Fingerprints in tight balls, at every distance up to six bits, with the bits anywhere."""
    monkeypatch.setattr(simhash, "CELL_ROWS", cell)
    monkeypatch.setattr(simhash, "CELL_BLOCK", block)
    rng = np.random.default_rng(n)
    fps = {int(x) for x in rng.integers(0, 1 << 63, size=n // 2, dtype=np.uint64)}
    for x in list(fps)[: n // 4]:
        for k in (1, 3, 4, 5, 6):
            fps.add(x ^ sum(1 << int(b) for b in rng.choice(64, size=k, replace=False)))
    fps = np.array(sorted(fps), dtype=np.uint64)
    near = np.argwhere(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4, 1))
    df = spark.createDataFrame([(int(x),) for x in fps.astype(np.int64)], "fp long")
    links = [(r["a"], r["b"]) for r in simhash.fingerprint_links(df).collect()]
    at = {int(v): k for k, v in enumerate(fps.astype(np.int64))}
    assert classes(len(fps), [(at[a], at[b]) for a, b in links]) == classes(len(fps), near.tolist())


def test_simhash_odd_tables(spark):
    docs = spark.createDataFrame([(7, "same text here now", "x", "en"), (7, "same text here now", "x", "en"), (None, "same text here now", "x", "en"), (3, "quite another text than that", "x", "en")], SCHEMA)
    got = collections.Counter((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(docs).collect())
    assert got == {(7, 7): 2, (None, 7): 1, (3, 3): 1}
    assert sorted(r["doc_id"] for r in simhash.one_of_each(docs).collect()) == [3, 7]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0 and simhash.one_of_each(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        simhash.fingerprint_links(spark.createDataFrame([(1,)], "fp long"), errors=6)


def vectors():
    rng = np.random.default_rng(2)
    rows = [rng.standard_normal(32) for _ in range(150)]
    for k in range(60):  # at all cosines around the threshold
        base, other = rows[k], rng.standard_normal(32)
        other -= base * (other @ base) / (base @ base)
        c = 0.93 + 0.07 * k / 60
        rows.append(c * base / np.linalg.norm(base) + np.sqrt(1 - c * c) * other / np.linalg.norm(other))
    rows += [rows[3], rows[3], 5 * rows[4], 1e-30 * rows[5], 1e30 * rows[6]]
    return [v.astype(np.float32) for v in rows]


def test_vectors_match_all_pairs(spark):
    vs = vectors()
    odd = [None, [], [0.0] * 32, [float("nan")] * 32, [float("inf")] + [1.0] * 31, [None] + [1.0] * 31, [1.0] * 16]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(vs)] + [(1000 + i, v, 1) for i, v in enumerate(odd)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, n_links int")
    got = {r["vec_id"]: r for r in embeddings.similar_vectors(df).collect()}
    exact = {r["vec_id"]: r for r in embeddings.similar_vectors(df, miss=0).collect()}
    unit = np.stack([v.astype(np.float64) / np.linalg.norm(v.astype(np.float64)) for v in vs])
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    found = sum(got[i]["n_links"] for i in range(len(vs)))
    assert all(got[i]["n_links"] <= near[i].sum() for i in range(len(vs))) and found >= 0.97 * near.sum()
    assert [exact[i]["n_links"] for i in range(len(vs))] == near.sum(axis=1).tolist()
    assert [exact[i]["component_id"] for i in range(len(vs))] == classes(len(vs), np.argwhere(np.triu(near)).tolist())
    assert all(got[1000 + i][1:] == (0, 1000 + i, True) for i in range(len(odd)))
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())


def test_a_tight_group_of_vectors_is_dealt_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(4)
    base = rng.standard_normal(32)
    rows = [(i, (base + 0.02 * rng.standard_normal(32)).tolist()) for i in range(120)]
    got = embeddings.similar_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {(r["n_links"], r["component_id"]) for r in got} == {(119, 0)}
    assert embeddings.similar_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(7)
    v = rng.standard_normal((400, 64))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    w = 0.95 * v + np.sqrt(1 - 0.95**2) * np.linalg.qr(rng.standard_normal((64, 64)))[0][rng.integers(0, 64, 400)]
    w /= np.linalg.norm(w, axis=1, keepdims=True)
    true = np.einsum("ij,ij->i", v, w)
    errors, outside, i = [], 0, np.arange(400)
    for seed in range(20):
        codes = embeddings.encode(np.concatenate([v, w]), seed)
        again = embeddings.Codes.unpacked(codes.packed(), 64)
        estimate = again.estimate(i, i + 400)
        errors.append(estimate - true)
        outside += int((estimate < true - again.room(i, i + 400, 0.95)).sum())
    assert abs(np.mean(errors)) < 0.002 and outside == 0 and 0.005 < np.std(errors) < 0.05


def test_the_exact_way_misses_nothing(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK_ROWS", 32)
    monkeypatch.setattr(embeddings, "PAIRS", 100)
    vs = vectors()
    rows = [(i // 2, v.tolist()) for i, v in enumerate(vs)]  # each id twice
    got = sorted((r["vec_id"], r["n_links"]) for r in embeddings.similar_vectors(spark.createDataFrame(rows, "vec_id int, embedding array<float>"), miss=0).collect())
    unit = np.stack([v.astype(np.float64) / np.linalg.norm(v.astype(np.float64)) for v in vs])
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    assert got == sorted((i // 2, int(n)) for i, n in enumerate(near.sum(axis=1)))


def passage_docs():
    rng = np.random.default_rng(11)
    say = lambda n: " ".join(f"v{x}" for x in rng.integers(0, 5000, size=n))
    passage, line = say(55), say(60)
    edited = line.split()
    edited[30] = "other"
    rows = [
        (1, f"{say(40)}\n{say(30)} {passage} {say(25)}\n{say(10)}"),
        (2, f"{say(80)} {passage.upper()}"),
        (3, f"{say(33)}\n{line}\n{say(21)}"),
        (4, f"{' '.join(edited)}\n{say(90)}"),
        (5, f"{say(70)}\n{say(12)}"),
        (6, say(200) + "\n" + say(19)),
        (7, None),
        (8, ""),
        (9, say(400) + "\n" + passage.replace(" ", "\n", 1)),
    ]
    return rows, passage, line


def test_passages_wherever_they_stand(spark):
    rows, passage, line = passage_docs()
    docs = spark.createDataFrame([(i, t, "x", "en") for i, t in rows], SCHEMA)
    got = paragraphs.repeated_passages(docs).collect()
    texts = dict(rows)
    assert {r["doc_id"] for r in got if r["kind"] == "window"} >= {1, 2, 9}
    assert {r["doc_id"] for r in got if r["kind"] == "paragraph"} == {3, 4}
    assert not {r["doc_id"] for r in got} & {5, 6, 7, 8}
    for r in got:
        words = texts[r["doc_id"]][r["start"] : r["end"]].lower().split()
        assert len(words) == r["n_words"] and r["first_doc_id"] <= r["doc_id"] and r["kept"] == (r["doc_id"] == r["first_doc_id"])
        if r["kind"] == "window":
            assert " ".join(words) in " ".join(passage.lower().split()) or r["doc_id"] in (3, 4)
    cut = {r["doc_id"]: r["text"] for r in paragraphs.without_repeats(docs).collect()}
    assert cut[1] == texts[1] and cut[3] == texts[3] and cut[5] == texts[5] and cut[7] is None and cut[8] == ""
    assert passage.upper() not in cut[2] and len(cut[4]) < len(texts[4]) and texts[4].split("\n")[1] in cut[4]


def plain_classes(rows):
    """All paragraphs of 20 words or more, joined where they are equal or similar enough."""
    lines = []
    for i, t in rows:
        at = 0
        for x in (t or "").split("\n"):
            words = x.lower().split()
            if len(words) >= 20:
                lines.append((i, at + len(x) - len(x.lstrip()), tuple(words), paragraphs.shingle_set(x)))
            at += len(x) + 1
    same = lambda a, b: a[2] == b[2] or len(a[3] & b[3]) >= 0.8 * len(a[3] | b[3])
    c = classes(len(lines), [(i, j) for i in range(len(lines)) for j in range(i) if same(lines[i], lines[j])])
    n = collections.Counter(c)
    return {(x[0], x[1]): n[k] for x, k in zip(lines, c, strict=True) if n[k] > 1}


def test_paragraphs_match_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(paragraphs, "BLOCK_ROWS", 4)
    rng = np.random.default_rng(9)
    rows = []
    base = [[f"u{x}" for x in rng.integers(0, 900, size=rng.integers(15, 90))] for _ in range(25)]
    for i in range(90):
        lines = []
        for k in rng.integers(0, 25, size=3):
            words = list(base[k])
            for _ in range(int(rng.integers(0, 3))):
                words[int(rng.integers(0, len(words)))] = f"n{rng.integers(0, 9)}"
            lines.append(" ".join(words))
        rows.append((i, "\n".join(lines)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["start"]): r["occurrences"] for r in paragraphs.repeated_passages(docs).filter("kind = 'paragraph'").collect()}
    want = plain_classes(rows)
    assert len(set(want) - set(got)) <= 0.01 * len(want) and not set(got) - set(want)


def test_windows_are_shared_by_any_51_words():
    rng = np.random.default_rng(3)
    for trial in range(60):
        shared = [f"s{x}" for x in rng.integers(0, 60, size=51)]
        texts = [" ".join([f"a{trial}{k}{x}" for x in range(rng.integers(0, 90))] + shared + [f"b{trial}{k}{x}" for x in range(rng.integers(0, 90))]) for k in range(2)]
        p = paragraphs.parse(texts)
        at, h1, h2 = paragraphs.windows(p)
        sides = [set(zip(h1[p.doc[at] == k].tolist(), h2[p.doc[at] == k].tolist(), strict=True)) for k in range(2)]
        assert sides[0] & sides[1]


def test_places_are_code_points():
    texts = ["é  ñandú\n\n  x y", "", "last 😀 one"]
    p = paragraphs.parse(texts)
    words = [texts[d][s:e] for d, s, e in zip(p.doc, p.start, p.end, strict=True)]
    assert words == ["é", "ñandú", "x", "y", "last", "😀", "one"]
    assert len(set(p.h1.tolist())) == 7 and paragraphs.parse(["abc ABC abC"]).h1.tolist().count(p.h1[0]) == 0
    assert len(set(paragraphs.parse(["abc ABC abC"]).h1.tolist())) == 1


def test_passages_of_repeated_rows_and_of_none(spark):
    text = " ".join(f"q{x}" for x in range(90))
    docs = spark.createDataFrame([(1, text), (1, text), (2, "short")], "doc_id long, text string")
    assert paragraphs.repeated_passages(docs).count() == 0
    assert sorted(r["text"] or "" for r in paragraphs.without_repeats(docs).collect()) == sorted([text, text, "short"])
    assert paragraphs.repeated_passages(docs.limit(0)).count() == 0
    junk = spark.createDataFrame([(1, "Of " * 500), (2, "Of " * 30 + "\n" + "Of " * 40)], "doc_id long, text string")
    assert {r["doc_id"] for r in paragraphs.repeated_passages(junk).collect()} == {1, 2}


def plain_repeats(rows, least=51):
    """Words of every text that lie in ``least`` words which stand earlier, apart from the first such place in the same text."""
    seen, out = {}, {}
    for i, t in rows:
        words = t.lower().split()
        for x in range(len(words) - least + 1):
            first = seen.setdefault(tuple(words[x : x + least]), (i, x))
            if first[0] != i or x - first[1] >= least:
                out.setdefault(i, set()).update(range(x, x + least))
    return out


def test_passages_are_found_and_cut_as_wholes(spark):
    rng = np.random.default_rng(21)
    say = lambda n: [f"k{x}" for x in rng.integers(0, 9000, size=n)]
    rows = []
    for n in (50, 51, 52, 60, 75, 120, 200, 400):
        passage = say(n)
        # a text that shares only the middle of it comes first, one that shares it and more comes last
        rows += [say(40) + passage[n // 2 - 15 : n // 2 + 15] + say(40)]
        more = say(80)
        rows += [say(int(rng.integers(0, 70))) + passage + more + say(30), say(int(rng.integers(0, 70))) + passage + say(int(rng.integers(0, 70))), passage + more, [*say(9), *passage]]
    own = say(70)
    rows += [own + say(30) + own + own, ["of"] * 400, ["of"] * 90, (own[:7] * 40)[:200], say(300)]
    rows = [(i, "".join(w + ("\n" if rng.random() < 0.02 else "  " if rng.random() < 0.05 else " ") for w in words)) for i, words in enumerate(rows)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = paragraphs.repeated_passages(docs).filter("kind = 'window'").collect()
    texts, want, cut = dict(rows), plain_repeats(rows), {}
    for r in got:
        before, words = len(texts[r["doc_id"]][: r["start"]].split()), texts[r["doc_id"]][r["start"] : r["end"]].split()
        assert len(words) == r["n_words"] >= 51
        if not r["kept"]:
            cut.setdefault(r["doc_id"], set()).update(range(before, before + len(words)))
    assert cut == want
    left = {r["doc_id"]: r["text"].lower().split() for r in paragraphs.without_repeats(docs).collect()}
    lines = {r["doc_id"] for r in paragraphs.repeated_passages(docs).filter("kind = 'paragraph' and not kept").collect()}
    assert all(left[i] == [w for k, w in enumerate(t.lower().split()) if k not in want.get(i, ())] for i, t in rows if i not in lines)


def test_one_row_without_id_keeps_a_paragraph(spark):
    line = " ".join(f"z{x}" for x in range(30))
    docs = spark.createDataFrame([(None, f"{line}\nrest {k}") for k in range(4)], "doc_id long, text string")
    assert sorted(r["kept"] for r in paragraphs.repeated_passages(docs).collect()) == [False] * 3 + [True]
    assert sum(line in r["text"] for r in paragraphs.without_repeats(docs).collect()) == 1


def left_over(texts: dict[int, list[str]], size: int = 51) -> dict[int, list[str]]:
    """By plain search: the words of each text, in the order of ids, that lie in no run of ``size`` words which stood before."""
    first: dict[tuple, tuple[int, int]] = {}
    out = {}
    for i in sorted(texts):
        words = texts[i]
        cut = [False] * len(words)
        for p in range(len(words) - size + 1):
            at = first.setdefault(tuple(words[p : p + size]), (i, p))
            if at[0] < i or p - at[1] >= size:
                cut[p : p + size] = [True] * size
        out[i] = [w for w, gone in zip(words, cut, strict=True) if not gone]
    return out


def test_what_is_cut_is_what_plain_search_cuts(spark):
    """Passages of 40 to 140 words that several texts share, whole or in part, at any place, once or twice."""
    rng = np.random.default_rng(21)
    fresh = lambda n: [f"w{x}" for x in rng.integers(0, 10**6, n)]
    shared = [fresh(n) for n in (40, 50, 51, 52, 60, 75, 90, 110, 140)]
    texts = {}
    for i in range(200):
        words = fresh(int(rng.integers(60, 160)))
        for _ in range(int(rng.integers(0, 3))):
            passage = shared[int(rng.integers(0, len(shared)))]
            if i % 3 == 0 and len(passage) > 60:  # a part of it
                lo = int(rng.integers(0, len(passage) - 55))
                passage = passage[lo : lo + int(rng.integers(51, len(passage) - lo + 1))] if len(passage) - lo >= 51 else passage
            at = int(rng.integers(0, len(words) + 1))
            words[at:at] = passage
        texts[i] = words
    docs = spark.createDataFrame([(i, " ".join(w), "x", "en") for i, w in texts.items()], SCHEMA)
    got = {r["doc_id"]: r["text"].split() for r in paragraphs.without_repeats(docs).collect()}
    want = left_over(texts)
    assert sum(len(w) for w in texts.values()) - sum(len(w) for w in want.values()) > 4000
    # texts that are alike as a whole (0.8 or more) are cut as paragraphs: there are none here
    assert {i for i in texts if got[i] != want[i]} == set()
