"""The manifest against a plain tree."""

import collections
import hashlib
import zlib

import pytest

from textloom.llm import common, merkle, queries


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(r, text):
    return h(*map(field, (r[0], r[1], r[2], r[3], text)))


def climb(digests):
    """The root, and each leaf's siblings on the way as pairs."""
    paths, where = [[] for _ in digests], list(range(len(digests)))
    while len(digests) > 1:
        for i, at in enumerate(where):
            lo = at - at % 3
            run = digests[lo : lo + 3]
            paths[i].append(("".join(run[: at % 3]), "".join(run[at % 3 + 1 :])))
        digests = [h(*digests[k : k + 3]) for k in range(0, len(digests), 3)]
        where = [w // 3 for w in where]
    return digests[0], paths


def brute(rows):
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[1]].append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees, out = {}, []
    for name in names:
        groups[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
        trees[name] = climb([leaf(r, r[4]) for r in groups[name]])
    root, upper = climb([trees[n][0] for n in names]) if names else (None, [])
    for name, up in zip(names, upper, strict=True):
        for r, own in zip(groups[name], trees[name][1], strict=True):
            path = own + up
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            fold = leaf(r, r[4].replace("\n", "") if tampered and r[4] is not None else r[4])
            for before, after in path:
                fold = h(before, fold, after)
            out.append((r[0], leaf(r, r[4]), trees[name][0], root, h(*(b + a for b, a in path)), fold, fold == root))
    return sorted(out, key=str)


def made(spark, rows, monkeypatch):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, node int, `group` string")
    monkeypatch.setattr(common, "read", lambda *_: df)
    return sorted((tuple(r) for r in queries.op13_merkle_manifest(spark, "").collect()), key=str)


ODD = [
    (1, "s", "en", 3, "a\nb"), (1, "s", "en", 3, "a\nb"), (None, "s", None, None, None), (None, None, None, None, None), (2, "s", "en", 0, ""), (3, "s", "de", 1, "é" * 50_000 + "\n"),
    (4, "~", "en", 1, "x"), (5, "", "en", 1, "x"), (6, "é", "en", 1, "x\n"), (7, "\U0001f600", "en", 1, "x"), (8, "￮", "en", 1, "\n\n"), (9, None, "en", 1, "x"), (1, "s", "en", 4, "a\nb"),
]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, len(ODD)])
def test_odd_rows(spark, monkeypatch, n):
    assert made(spark, ODD[:n], monkeypatch) == brute(ODD[:n])


def test_many_leaves_and_a_hot_record(spark, monkeypatch):
    rows = [(i, f"s{i % 7 if i % 3 else 0}", "en", i, f"t{i}\n") for i in range(700)] + [(5, "s0", "en", 5, "copy")] * 250
    assert made(spark, rows, monkeypatch) == brute(rows)


def test_many_sources(spark, monkeypatch):
    rows = [(i, f"s{i}", None, i, "t\n" * (i % 3)) for i in range(100)]
    got = made(spark, rows, monkeypatch)
    assert got == brute(rows)
    assert {r[6] for r in got} == {True, False}


def test_places_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame([(i % 50, f"s{i % 2}", None, i, "t") for i in range(300)], "doc_id long, source string, lang string, n_chars long, text string")
    roots = {merkle.manifest(df.repartition(p)).select("root").distinct().first()[0] for p in (1, 3, 9)}
    assert len(roots) == 1
