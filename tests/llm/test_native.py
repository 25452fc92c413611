"""Quality rules, sharding, mixing and URL filters against plain computations, on awkward rows."""

import collections
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from textloom.llm import common, mixing, quality, sharding, urls

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = "alpha beta gamma " * 700 + "end"
ROWS = [
    (1, "one two three\none two three\n\nfour # $5", "en", "s1", "x"),
    (2, None, "en", "s1", "x"),
    (3, "", None, "s1", "x"),
    (4, " \t\n ", "de", None, "x"),
    (5, LONG, "en", "s2", "x"),
    (5, LONG, "en", "s2", "x"),
    (None, "naïve\u00a0text with | bars <a>", "fr", "s2", "x"),
    (7, " ".join(f"w{i}" for i in range(60)), "en", "s2", "x"),
    (8, "a b c a b c a b", "en", "s1", "x"),
    (2, "same id, other text", "en", "s1", "x"),
]
SCHEMA = "doc_id long, text string, lang string, source string, kept string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = {w for w, n in collections.Counter(windows).items() if n > 1}
    covered = {j for i, w in enumerate(windows) if w in often for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(docs):
    got = sorted((tuple(r)[:6] for r in quality.judge_quality(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()), key=repr)
    assert got == sorted(((r[0], *counts(r[1])) for r in ROWS), key=repr)


def prose(i: int) -> str:
    rng = random.Random(i)
    return " ".join("x" * rng.randint(1, 9) + str(rng.randint(0, 999)) for _ in range(rng.randint(60, 300)))


def test_quality_verdicts(spark):
    clean = [(i, prose(i), "en", f"s{i % 2}", "") for i in range(120)]
    bad = [(900, " ".join(f"w{k}###%%%" for k in range(80)), "en", "s0", ""), (901, "spam ham egg " * 40, "en", "s0", ""), (902, "short", "en", "s1", "")]
    got = {r["doc_id"]: r for r in quality.judge_quality(spark.createDataFrame(clean + bad, SCHEMA)).collect()}
    assert all(got[i]["kept"] for i in range(120))
    assert not got[900]["base_failed"] and not got[900]["kept"]
    assert got[901]["base_failed"] and got[902]["base_failed"] and not got[902]["kept"]


def test_thresholds_follow_the_source(spark):
    """A source whose documents all hold many symbols keeps them; where none do, one that does is out."""
    table = lambda i: prose(i).replace(" ", " | ")
    rows = [(i, table(i), "en", "tables", "") for i in range(60)] + [(100 + i, prose(i), "en", "prose", "") for i in range(60)] + [(999, table(3), "en", "prose", "")]
    got = {r["doc_id"]: r["kept"] for r in quality.judge_quality(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[i] for i in range(60)) and all(got[100 + i] for i in range(60)) and not got[999]


def test_bounds_come_from_the_data(spark):
    """A wider spread gives wider bounds, in proportion; copies in any number leave the bounds as they are."""
    measured = lambda spread: spark.range(1, 201).selectExpr("'en' AS lang", "'s' AS source", f"5 + {spread}D * (id - 100) / 100 AS word_length", f"-8 + {spread}D * id / 100 AS symbol_odds", "-3D AS dup_line_odds", "id / 100 AS repeat_odds")
    wide, narrow = (quality.thresholds(measured(x)).first()["bounds"] for x in (2.0, 0.5))
    room = lambda b: b["word_length"]["high"] - b["word_length"]["low"]
    assert abs(room(wide) / room(narrow) - 4) < 1e-9 and wide["symbol_odds"]["high"] > narrow["symbol_odds"]["high"] and wide["symbol_odds"]["low"] is None
    texts = [(i, prose(i), "en", "s", "") for i in range(80)]
    once = {r["doc_id"]: r["outside"] for r in quality.judge_quality(spark.createDataFrame(texts, SCHEMA)).collect()}
    copies = [(1000 + i, texts[5][1], "en", "s", "") for i in range(500)]
    more = {r["doc_id"]: r["outside"] for r in quality.judge_quality(spark.createDataFrame(texts + copies, SCHEMA)).collect()}
    assert all(more[i] == once[i] for i in once)


def test_shards(docs):
    got = sharding.shard_documents(docs, [1.0] * 8).collect()
    assert len(got) == len(ROWS)
    want = collections.Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in ROWS)
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    by = collections.defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert len({r["shard"] for r in got if r["doc_id"] == 5}) == 1


def test_a_new_shard_takes_only_into_itself(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    got = sharding.shard_documents(rows, [1.0, 2.0, 1.0], new_weight=1.0).collect()
    assert all(r["grown_shard"] in (r["shard"], 3) for r in got)
    share = collections.Counter(r["shard"] for r in got)
    assert abs(share[1] / 3000 - 0.5) < 0.04 and abs(sum(r["grown_shard"] == 3 for r in got) / 3000 - 0.2) < 0.04
    with pytest.raises(ValueError):
        sharding.rendezvous(F.lit("x"), [])


def test_mixing_keeps_and_repeats(docs):
    got = mixing.mix(docs, max_repeats=2.0, block_tokens=500).collect()
    tokens = lambda t: len(WORD.findall(t or ""))
    records = {(d, s, t) for d, t, _, s, _ in ROWS}
    first = collections.Counter((r["doc_id"], r["source"]) for r in got if r["epoch"] == 0)
    assert first == collections.Counter((d, s) for d, s, _ in records)
    total = collections.defaultdict(int)
    for d, t, _, s, _ in ROWS:
        total[s] += tokens(t)
    read = collections.defaultdict(int)
    for r in got:
        read[r["source"]] += r["tokens"] * r["copies"]
    assert all(total[s] <= read[s] for s in total) and max(r["epoch"] for r in got) <= 1
    blocks = collections.defaultdict(list)
    for r in got:
        blocks[r["block"]].append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in blocks.values())


def entropy(w):
    return -sum(x * math.log(x) for x in w if x > 0)


def test_weights_meet_their_target(spark):
    n = {"a": 10_000, "b": 1000, "c": 100, "z": 0}
    totals = spark.createDataFrame(list(n.items()), "source string, tokens long")
    by = lambda **k: {r["source"]: r for r in mixing.source_weights(totals, **k).collect()}
    w = by(max_repeats=4.0)
    assert w["z"]["weight"] == 0 and abs(sum(r["weight"] for r in w.values()) - 1) < 1e-9
    assert abs(w["c"]["repeats"] - 4) < 0.02 and w["a"]["repeats"] == 1
    w = by(target_entropy=0.8)
    assert entropy([r["weight"] for r in w.values()]) == pytest.approx(0.8 * math.log(3), abs=1e-3)
    w = by(max_repeats=3.0, budget=6000)
    assert w["c"]["repeats"] == pytest.approx(3, abs=0.02) and sum(r["quota"] for r in w.values()) == pytest.approx(6000, abs=3)
    assert by(max_repeats=1000.0)["a"]["exponent"] == 0


def test_a_budget_takes_shares(spark):
    rows = [(i, "w " * 10, "en", "big" if i < 900 else "small", "") for i in range(1000)]
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA), max_repeats=3.0, budget=5000, block_tokens=1000).collect()
    read = collections.Counter(r["source"] for r in got)
    assert read["small"] == pytest.approx(246, abs=60) and read["big"] + read["small"] == pytest.approx(500, abs=3)
    assert len({r["block"] for r in got}) == 5


def test_mixed_rows_keep_their_columns(docs):
    got = mixing.mixed_documents(docs)
    assert got.columns == docs.columns and got.count() >= len(ROWS)


RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"), ("block", "a.b.example.com", "/")]


def plain_url(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fit = [(len(h) + len(p), len(h), h + p, a) for a, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


def test_url_rules(spark):
    parts = ["com", "example.com", "www.example.com", "WWW.Example.com", "x.www.example.com", "b.example.com", "a.b.example.com", "q.a.b.example.com", "notexample.com", "example-.com", "net", "x.net", "localhost", "", "com.", ".com", "ex,ample.com"]
    tails = ["", "/", "/en", "/en/1?x=/en/", "/es/#top", "/fr/?a", "?q=/en/", "#/en/"]
    made = [f"http://{h}{t}" for h in parts for t in tails] + [None, "no scheme", "a://b://c.com/en/", "http://x.com/en/\nmore"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(made + made[:5])], "page_id long, url string, host string")
    rules = spark.createDataFrame(RULES, "action string, host string, path string")
    got = urls.judge_urls(pages, rules).collect()
    assert len(got) == len(made) + 5
    assert {r["page_id"]: tuple(r)[1:] for r in got} == {i: plain_url(u) for i, u in enumerate(made + made[:5])}


def test_url_groups_are_many(spark, monkeypatch):
    monkeypatch.setattr(urls, "GROUP_ROWS", 7)
    pages = spark.range(500).select(F.col("id").alias("page_id"), F.concat(F.lit("http://www.example.com/en/"), "id").alias("url"))
    rules = spark.createDataFrame(RULES, "action string, host string, path string")
    got = urls.judge_urls(pages, rules).groupBy("rule", "verdict").count().collect()
    assert [tuple(r) for r in got] == [("www.example.com/en/", "allow", 500)]
    assert {r["verdict"] for r in urls.judge_urls(pages, rules.limit(0), default="block").collect()} == {"block"}


def test_empty_tables(spark, none):
    assert quality.judge_quality(none).count() == 0
    assert sharding.shard_documents(none, [1.0] * 8).count() == 0
    assert mixing.mix(none).count() == 0 and mixing.mixed_documents(none).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string")
    assert urls.judge_urls(pages, spark.createDataFrame(RULES, "action string, host string, path string")).count() == 0


def test_pair_blocks_meet_every_pair_once(spark):
    rows = spark.createDataFrame([(k, i) for k, n in ((1, 23), (2, 2), (3, 1)) for i in range(n)], "k int, id long")
    met = collections.Counter()
    groups = collections.defaultdict(list)
    for r in common.with_pair_blocks(rows, ["k"], "id", 5).collect():
        groups[r["k"], r["lo_block"], r["hi_block"]].append((r["block"], r["id"]))
    for (k, low, high), members in groups.items():
        for a, x in members:
            for b, y in members:
                if x < y and {a, b} == {low, high}:
                    met[k, x, y] += 1
    assert set(met.values()) == {1} and len(met) == 23 * 22 // 2 + 1


MARKED = [(1, "a b c", None), (1, "a b c", "~"), (1, "a b c", "-"), (1, "a b c", "1:~"), (1, None, "~"), (1, "~", "~"), (None, "x y", "a|b"), (2, "x y", "a|b"), (None, None, None), (None, "", None), (1, "a b c", "~")]


def test_null_and_its_marks_are_different_sources(spark):
    docs = spark.createDataFrame(MARKED, "doc_id long, text string, source string")
    made = mixing.mix(docs).filter("epoch = 0").collect()
    got = collections.Counter({(r["doc_id"], r["source"], r["tokens"]): r["copies"] for r in made})
    want = collections.Counter((i, s, len((t or "").split())) for i, t, s in MARKED)
    assert sum(r["copies"] for r in made) == len(MARKED) and {r["source"] for r in made} == {s for _, _, s in MARKED}
    assert {k for k in got} == set(want) and len(made) == len(set(MARKED))
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(i, f"{text} {i} " + ("# " * 30 if i % 2 else ""), lang, source) for i in range(120) for lang, source in ((None, "~") if i % 2 else ("~", None), )]
    judged = quality.judge_quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    assert judged.filter("kept").count() == len(rows)  # two groups, each alike in itself
    assert judged.select("doc_id").distinct().count() == len(rows)


def test_records_without_words_are_spread(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_RECORDS", 10)
    docs = spark.createDataFrame([(i, None if i % 2 else " ", "s") for i in range(300)], "doc_id long, text string, source string")
    made = mixing.mix(docs).collect()
    blocks = collections.Counter(r["block"] for r in made)
    assert len(made) == 300 and len(blocks) > 20 and max(blocks.values()) < 30
    assert all(sorted(r["slot"] for r in made if r["block"] == b) == list(range(n)) for b, n in blocks.items())
