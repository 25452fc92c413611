import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from textloom.operators import aggregates, answers, designs, evidence, failures, plots, report, runs, statistics, validation


def frame_of(spark, rows):
    """A run frame with the columns that the rows give, and nulls in all others."""
    schema = runs.run_frame(spark.createDataFrame([], StructType.fromDDL(runs.RUN_RECORD))).schema
    full = [tuple({"design_cell": "primary", "status": "ok"}.get(f.name) if f.name not in r else r[f.name] for f in schema) for r in rows]
    return spark.createDataFrame(full, StructType([StructField(f.name, f.dataType) for f in schema]))


PAIRS = [("000001", False, True, 10, 12, 0.0, 2, "alpha"), ("000002", True, False, 20, 22, 0.5, 2, "alpha"), ("000003", True, True, 30, 30, 1.0, 3, "beta"), ("000004", False, False, 40, 41, 0.5, 3, "beta")]


@pytest.fixture(scope="module")
def frame(spark):
    rows = []
    for t, s, v, ts, tv, recall, hops, category in PAIRS:
        for condition, won, tokens in (("snippets", s, ts), ("vfs", v, tv)):
            rows.append({"run_key": f"e:{t}:{condition}", "task_id": t, "condition": condition, "success": won, "total_tokens": tokens, "tokens": tokens, "initial_recall": recall, "hop_count": hops, "category": category, "distractor_count": 6, "tool_call_count": 2 if condition == "vfs" else 0})
    return frame_of(spark, rows)


def test_paired_summary(frame):
    got = statistics.paired_summary(frame, resamples=500).first()
    assert (got["n"], got["difference"], got["mcnemar_p_value"]) == (4, 0, 1)
    assert got["ci_lower"] <= 0 <= got["ci_upper"]


def test_bootstrap_draws_as_one_matrix(monkeypatch):
    d = np.array([1.0, 0, -1, 1, 0])
    rng = np.random.default_rng(7)
    want = np.percentile(d[rng.integers(0, 5, size=(200, 5))].mean(axis=1), (2.5, 97.5))
    assert statistics.bootstrap_interval(d, 200, 7) == pytest.approx(tuple(want))
    monkeypatch.setattr(statistics, "HELD", 400)
    assert statistics.bootstrap_interval(d, 200, 7) == pytest.approx(tuple(want))


@pytest.mark.parametrize("n,resamples,drawn", [(1, 7, 1 << 10), (2, 50, 1 << 10), (5, 300, 64), (1000, 200, 1 << 12), (3, 40, 1 << 22), (70_001, 60, 1 << 18), (4096, 30, 1 << 14)])
def test_parts_of_the_matrix_are_drawn_apart(spark, monkeypatch, n, resamples, drawn):
    """Every sum is that of numpy's own matrix, to the last digit, however the stream is cut."""
    monkeypatch.setattr(statistics, "DRAWN", drawn)
    d = np.random.default_rng(n).integers(-1, 2, n).astype(np.int8)
    want = d.astype(int)[np.random.default_rng(11).integers(0, n, size=(resamples, n))].sum(axis=1)
    got = statistics.bootstrap_sums(spark, d, resamples, 11).orderBy("nth").toPandas()
    assert got["nth"].tolist() == list(range(resamples)) and got["total"].tolist() == want.tolist()


def test_draws_that_are_thrown_away():
    n = 3_000_000_000  # half of the draws
    want = np.random.default_rng(3).integers(0, n, size=5000)
    got = np.concatenate([statistics._accepted(3, n, 0)])
    assert len(got) < 0.9 * statistics.DRAWN and (got[:5000] == want).all()


def test_the_interval_of_a_frame_is_the_matrix_interval(spark, frame):
    pairs = sorted((t, int(v) - int(s)) for t, s, v, *_ in PAIRS)
    want = statistics.bootstrap_interval(np.array([d for _, d in pairs], float), 400, 5)
    got = statistics.paired_summary(frame, resamples=400, seed=5).first()
    assert (got["ci_lower"], got["ci_upper"]) == want


@pytest.mark.parametrize("kind", ["normal", "ties", "two", "constant", "heavy", "whole"])
def test_quantiles_by_selection(spark, monkeypatch, kind):
    monkeypatch.setattr(statistics, "NEAR", 50)
    monkeypatch.setattr(statistics, "PIVOTS", 8)
    rng = np.random.default_rng(2)
    values = {"normal": rng.normal(size=3000), "ties": rng.integers(0, 9, 2000), "two": rng.integers(0, 2, 999), "constant": np.ones(500), "heavy": np.exp(rng.normal(0, 9, 2500)), "whole": rng.integers(-(10**6), 10**6, 4001)}[kind]
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)] * 7, "x double")
    shares = (0, 0.003, 0.25, 0.5, 0.75, 0.9, 1)
    want = df.selectExpr(f"percentile(x, array({', '.join(map(str, shares))}))").first()[0]
    assert statistics.exact_quantiles(df, "x", shares) == list(want)
    assert statistics.exact_quantiles(df.filter("x is null"), "x", shares) is None


@pytest.mark.parametrize("b,c", [(3, 1), (0, 0), (5, 5), (12, 3), (900, 800), (2000, 1700)])
def test_exact_test(spark, b, c):
    n, k = b + c, min(b, c)
    want = 1.0 if not n else min(1.0, 2 * sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2)) for i in range(k + 1)))
    got = spark.range(1).select(statistics.exact_mcnemar(F.lit(b), F.lit(c))).first()[0]
    assert got == pytest.approx(1.0 if b == c else want, rel=1e-9)
    assert (b, c) != (3, 1) or got == pytest.approx(0.625)


def test_strata_keep_their_empty_bands(frame):
    got = {(r["stratum"], r["band"]): r for r in statistics.stratified(frame).collect()}
    assert got["recall_band", "(0,1)"]["n"] == 2 and got["hop", "2"]["n"] == 2 and got["category", "beta"]["difference"] == 0
    values = [t for row in PAIRS for t in row[3:5]]
    edges = np.quantile(values, [0.25, 0.5, 0.75])
    band = lambda x: f"q{np.searchsorted(edges, x, side='right') + 1}"
    for q in ("q1", "q2", "q3", "q4"):
        assert got["token_quartile", q]["n"] == sum(band(r[3]) == band(r[4]) == q for r in PAIRS)
    assert all((r["missing_reason"] is None) == (r["n"] > 0) for r in got.values())


def test_equal_tokens_are_one_quartile(spark):
    got = spark.range(1).select(statistics.token_quartile(F.lit(5.0), F.array(F.lit(5.0))), statistics.token_quartile(F.lit(20.0), F.array(F.lit(10.0), F.lit(20.0), F.lit(30.0)))).first()
    assert got[:] == ("q1", "q2")


def test_incomplete_pairs(spark, frame):
    odd = frame.filter("not (task_id = '000004' and condition = 'vfs')")
    assert {r["outcome"]: r["count"] for r in aggregates.paired_counts(odd).collect()} == {"both_succeed": 1, "snippets_only": 1, "vfs_only": 1, "both_fail": 0}
    assert aggregates.paired_outcomes(odd, 100).first()["status"] == "incomplete_pairs"
    assert aggregates.paired_outcomes(frame.union(frame.limit(1)), 100).first()["status"] == "duplicate_primary_record"
    with pytest.raises(ValueError):
        aggregates.paired(odd, strict=True)
    states = {r["task_id"]: r["status"] for r in aggregates.task_level(odd).collect()}
    assert states["000004"] == "incomplete_pair" and states["000001"] == "ok"


def test_summaries_count_nulls_as_their_kind_asks(spark):
    rows = [{"run_key": str(i), "task_id": str(i), "condition": "vfs", "success": i == 0, "total_tokens": t, "tool_call_count": c, "citation_recall": r} for i, (t, c, r) in enumerate([(100, 3, 1.0), (100, None, None)])]
    got = aggregates.condition_summary(frame_of(spark, rows)).first()
    assert (got["n"], got["successes"], got["success_per_1000_tokens"], got["actual_tool_calls_mean"], got["citation_recall_mean"]) == (2, 1, 5.0, 1.5, 1.0)
    assert len(got) == 2 + 43


def test_interventions_go_by_permitted_calls(spark):
    rows = [{"run_key": str(i), "task_id": str(i), "condition": "vfs", "design_cell": "max_calls_2", "max_tool_calls_permitted": p, "tool_call_count": 5} for i, p in enumerate((2, None))]
    got = aggregates.intervention_summary(frame_of(spark, rows)).collect()
    assert [(r["permitted_call_limit"], r["actual_tool_calls"]) for r in got] == [(2, 10)]


def test_nothing_gives_a_status_row(spark):
    got = aggregates.or_not_run(aggregates.condition_summary(frame_of(spark, []))).collect()
    assert len(got) == 1 and got[0]["status"] == "not_run" and got[0]["n"] is None


def test_regression_recovers_coefficients(spark):
    rng = np.random.default_rng(0)
    n = 1500
    x = np.stack([np.ones(n), rng.standard_normal(n), rng.standard_normal(n)], axis=1)
    y = (rng.random(n) < 1 / (1 + np.exp(-(x @ [0.3, 1.0, -0.5])))).astype(float)
    parts = [(x[k::4], y[k::4]) for k in range(4)]  # sums over parts, as over partitions
    total = lambda got: tuple(sum(v) for v in zip(*got, strict=True))
    beta, cov = statistics.fit_logit(lambda b: total([statistics.logit_sums(*part, b) for part in parts]), lambda b, bread: sum(statistics.meat_sums(*part, b, bread) for part in parts))
    mean = 1 / (1 + np.exp(-(x @ beta)))
    assert np.abs(x.T @ (y - mean)).max() < 1e-5  # the score is zero at the estimate
    assert np.allclose(beta, [0.3, 1.0, -0.5], atol=0.2) and (np.diag(cov) > 0).all()


def test_regression_says_why_not(frame):
    got = statistics.within_vfs_regression(frame).collect()
    assert [(r["term"], r["status"]) for r in got] == [("__status__", "error")] and "too few" in got[0]["error"]
    twice = frame.union(frame.filter("condition = 'vfs'").limit(1))
    assert "twice" in statistics.within_vfs_regression(twice).first()["error"]


def test_regression_over_partitions(spark):
    """On runs spread over partitions: the score is zero at the estimates, and the covariance is that of the plain formula."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(600):
        calls, recall, hops, tokens, far, cat = int(rng.integers(0, 9)), float(rng.integers(0, 5)) / 4, int(rng.integers(2, 5)), int(rng.integers(300, 4000)), int(rng.integers(0, 7)), f"c{rng.integers(0, 3)}"
        p = 1 / (1 + np.exp(-(-1 + 0.3 * calls + recall - 0.0003 * tokens + (cat == "c1"))))
        rows.append((f"t{i:04d}", bool(rng.random() < p), calls, recall, hops, tokens, far, cat, "primary", "vfs"))
    runs_ = spark.createDataFrame(rows, "task_id string, success boolean, tool_call_count int, initial_recall double, hop_count int, total_tokens long, distractor_count int, category string, design_cell string, condition string").repartition(5)
    got = {r["term"]: r for r in statistics.within_vfs_regression(runs_).collect()}
    terms = [*statistics.TERMS, "category_c1", "category_c2"]
    assert got["__status__"]["status"] == "converged" and set(got) == {*terms, "__status__"}
    x, y = statistics.design(pd.DataFrame(rows, columns=runs_.columns), ["c0", "c1", "c2"])
    beta = np.array([got[t]["coefficient"] for t in terms])
    mean = 1 / (1 + np.exp(-(x @ beta)))
    assert np.abs((x.T @ (y - mean)) / np.abs(x).sum(axis=0)).max() < 1e-6
    bread = np.linalg.inv(x.T @ (x * (mean * (1 - mean))[:, None]))
    hat = mean * (1 - mean) * np.einsum("ij,jk,ik->i", x, bread, x)
    part = x * ((y - mean) / (1 - hat))[:, None]
    want = np.sqrt(np.diag(bread @ part.T @ part @ bread))
    assert np.allclose([got[t]["std_error"] for t in terms], want, rtol=1e-4)


def test_bootstrap_from_counts_has_the_same_law():
    d = np.array([-1] * 20 + [0] * 50 + [1] * 30, dtype=float)
    a, b = statistics.bootstrap_interval(d, 4000), statistics.interval_from_counts(20, 50, 30, 4000)
    assert np.allclose(a, b, atol=0.025)


def test_leaks_are_found_by_their_rarest_part(spark):
    docs = spark.createDataFrame([("a", "xx what is the answer to this yy"), ("b", "what is the answer to that"), ("c", "pre-what is the answer to this-post"), ("d", "short q here"), ("e", "")], "doc_id string, content string")
    tasks = spark.createDataFrame([("1", "what is the answer to this"), ("2", "rt q"), ("3", "no such question at all"), ("4", ""), ("5", "is the")], "task_id string, question string")
    got = sorted((r["task_id"], r["doc_id"]) for r in validation.leaks(tasks, docs).collect())
    assert got == [("1", "a"), ("1", "c"), ("2", "d"), ("5", "a"), ("5", "b"), ("5", "c")]


def record(spark, **given):
    schema = StructType.fromDDL(runs.RUN_RECORD)
    base = {"run_key": "e:t:vfs:primary", "task_id": "task-eval-000001", "condition": "vfs", "design_cell": "primary", "correctness": True, "tool_call_count": 0, "repeated_tool_calls": 0, "invalid_tool_calls": 0}
    row = base | given
    return spark.createDataFrame([tuple(row.get(f.name) for f in schema)], schema)


EVIDENCE = lambda recall, whole, cited: (recall, 1.0, 1, whole, cited, 1.0)


@pytest.mark.parametrize(
    "given,want",
    [
        ({"scoring_details": ("valid", None), "evidence_metrics": EVIDENCE(1.0, True, 1.0), "retrieval_metrics": (0.5, 0.5, 8)}, []),
        ({"scoring_details": ("valid", None), "evidence_metrics": EVIDENCE(0.5, False, 1.0), "retrieval_metrics": (0.0, 0.0, 8)}, ["initial_retrieval_miss", "incomplete_evidence_coverage"]),
        ({"scoring_details": ("malformed", None), "correctness": False, "evidence_metrics": EVIDENCE(1.0, True, 0.5)}, ["incorrect_evidence_composition", "unsupported_answer", "malformed_final_answer"]),
        ({"scoring_details": ("valid", None), "correctness": False, "evidence_metrics": EVIDENCE(1.0, True, 1.0)}, ["correct_evidence_wrong_conclusion"]),
        ({"scoring_details": ("valid", None), "evidence_metrics": EVIDENCE(1.0, True, 1.0), "termination_reason": "budget_exhausted", "invalid_tool_calls": 1}, ["budget_exhaustion", "invalid_tool_call"]),
    ],
)
def test_failure_classes(spark, given, want):
    assert record(spark, **given).select(failures.failure_classes()).first()[0] == want


@pytest.mark.parametrize("calls,repeats,want", [(6, 2, False), (4, 2, True), (5, 3, True), (0, 0, False)])
def test_excessive_repeats(spark, calls, repeats, want):
    assert spark.range(1).select(F.coalesce(failures.excessive_repeats(F.lit(calls), F.expr(str(repeats))) if calls else F.lit(False), F.lit(False))).first()[0] is want


def test_run_frame_derives_what_is_missing(spark):
    r = record(spark, design_cell="max_calls_4", gold_evidence=(["fact-1", "fact-2"], ["doc-data-systems-0001"], []), token_accounting=(100, 20, 10, None, None, None, []), tool_call_count=None, tool_trace=[("a", 1, "read", "{}", True, None, [], False, 1.0)])
    got = runs.run_frame(r).first()
    assert (got["split"], got["hop_count"], got["category"], got["total_tokens"], got["budget_bucket"], got["tool_call_count"], got["max_tool_calls_permitted"]) == ("eval", 2, "data-systems", 30, "25-50%", 1, 4)
    assert len(got) == 80


def test_answers():
    good = '{"answer": "x", "citations": ["d", "d", "e"], "justification": "j"}'
    assert answers.parse_one(f"  {good}\n") == {"answer": "x", "citations": ["d", "e"], "justification": "j"}
    assert answers.parse_one(good, strict_keys=False) is None
    for bad in (None, "", "[]", f"```json\n{good}\n```", good + " x", good[:-1] + ', "answer": "y"}', good.replace('"j"', f'"{"j" * 241}"'), good.replace('"x"', "1"), good.replace('["d", "d", "e"]', '"d"')):
        assert answers.parse_one(bad) is None


def test_answer_columns(spark):
    df = spark.createDataFrame([('{"answer": "A", "citations": [], "justification": ""}',), ("nope",), (None,)], "raw string")
    got = [r[0] for r in df.select(answers.parse_answer(F.col("raw"))).collect()]
    assert got[0]["answer"] == "A" and got[0]["citations"] == [] and got[1]["answer"] is None and got[2]["answer"] is None


def test_citations(spark):
    s = answers.citation_score(F.array(*map(F.lit, ("doc-1", "doc-2::c0001", "doc-9", "doc-1", "doc-1::c0000"))), F.array(F.lit("doc-1"), F.lit("doc-2")), F.array(F.lit("doc-2::c0001")))
    got = spark.range(1).select(s.alias("s")).first()["s"]
    assert (got["precision"], got["recall"], got["document_precision"], got["chunk_precision"], got["chunk_recall"]) == (0.5, 1.0, 0.5, 0.5, 1.0)
    none = answers.citation_score(F.array().cast("array<string>"), F.array(F.lit("d")), F.array().cast("array<string>"))
    assert set(spark.range(1).select(none.alias("s")).first()["s"]) == {0.0}


def test_merged_ranges(spark):
    df = spark.createDataFrame([("p", 1, 3), ("p", 2, 4), ("p", 5, 6), ("p", 4, 4), ("q", 3, 9)], "path string, start_line int, end_line int")
    got = sorted(tuple(r) for r in evidence.merge_ranges(df, ["path"]).collect())
    assert got == [("p", 1, 4), ("p", 5, 6), ("q", 3, 9)]


def test_overlap_join_gives_each_pair_once(spark):
    rng = np.random.default_rng(1)
    spans = lambda n: [("p", int(a), int(a + b)) for a, b in zip(rng.integers(1, 200, n), rng.integers(0, 90, n), strict=True)]
    left, right = spans(30), spans(25)
    a = spark.createDataFrame([(i, *r) for i, r in enumerate(left)], "a int, path string, start_line int, end_line int")
    b = spark.createDataFrame([(i, *r) for i, r in enumerate(right)], "b int, path string, from_line int, to_line int")
    got = sorted((r["a"], r["b"]) for r in evidence.overlap_join(a, b).collect())
    assert got == [(i, j) for i, x in enumerate(left) for j, y in enumerate(right) if x[1] <= y[2] and y[1] <= x[2]]


@pytest.mark.parametrize("pairs", [7, 1 << 14])
def test_sweep_over_long_ranges_and_many_shares(spark, monkeypatch, pairs):
    """Ranges of a million lines, equal firsts, paths in one share and in several, ranges that overlap nothing."""
    monkeypatch.setattr(evidence, "PAIRS", pairs)
    rng = np.random.default_rng(8)

    def spans(n):
        out = [(f"p{int(p)}", int(a), int(a + b)) for p, a, b in zip(rng.integers(0, 3, n), rng.integers(1, 10**6, n), np.minimum(10**6, np.exp(rng.uniform(0, 14, n))), strict=True)]
        return [*out, ("p0", 1, 10**6), ("p0", 1, 1), ("p0", 500_000, 500_000), ("p1", 9, 3), ("p2", None, 4), (None, 1, 9), ("only", 5, 6), ("p0", 1, 10**6)]

    left, right = spans(300), [*spans(200), ("other", 5, 6)]
    a = spark.createDataFrame([(i, *r, "x") for i, r in enumerate(left)], "a int, path string, start_line int, end_line int, note string").repartition(5)
    b = spark.createDataFrame([(i, *r) for i, r in enumerate(right)], "b int, path string, from_line int, to_line int")
    got = evidence.overlap_join(a, b)
    assert got.columns == ["a", "path", "start_line", "end_line", "note", "b", "from_line", "to_line"]
    sound = lambda x: None not in x and x[1] <= x[2]
    want = [(i, j) for i, x in enumerate(left) for j, y in enumerate(right) if sound(x) and sound(y) and x[0] == y[0] and x[1] <= y[2] and y[1] <= x[2]]
    assert sorted((r["a"], r["b"]) for r in got.collect()) == want
    assert evidence.overlap_join(a.limit(0), b).count() == evidence.overlap_join(a, b.limit(0)).count() == 0


def test_evidence_of_a_trace(spark):
    facts = spark.createDataFrame([("fact-1", "/a", 2, 2), ("fact-3", "/a", 4, 4), ("fact-2", "/b", 2, 2)], "fact_id string, path string, line_start int, line_end int")
    trace = spark.createDataFrame([(1, 1, "read", True, [("/a", 2, 2)]), (1, 2, "list", True, [("/b", 1, 9)]), (1, 3, "read", False, [("/b", 1, 9)]), (1, 4, "cat", True, [("/b", 1, 2)]), (2, 1, "grep", True, [("/a", 2, 4)])], "run_id int, call_ordinal int, tool string, ok boolean, line_ranges array<struct<path:string,start_line:int,end_line:int>>")
    shown = evidence.content_ranges(trace)
    exposed = evidence.exposed_facts(shown, facts)
    need = spark.createDataFrame([(r, f) for r in (1, 2) for f in ("fact-1", "fact-2")], "run_id int, fact_id string")
    assert {r["run_id"]: r["ordinal"] for r in evidence.coverage_ordinal(exposed, need).collect()} == {1: 4, 2: None}
    m = evidence.evidence_metrics(F.array(F.lit("fact-1"), F.lit("fact-3")), F.array(F.lit("fact-1"), F.lit("fact-2")))
    assert spark.range(1).select(m.alias("m")).first()["m"][:] == (0.5, 0.5, 1, False)
    chunks = spark.createDataFrame([("a::c0", "a", "/a", 1, 3), ("b::c0", "b", "/b", 1, 3)], "chunk_id string, doc_id string, path string, start_line int, end_line int")
    got = {r["run_id"]: r for r in evidence.accessed_evidence(shown, facts, chunks).collect()}
    assert got[1]["fact_ids"] == ["fact-1", "fact-2"] and got[2]["fact_ids"] == ["fact-1", "fact-3"] and got[1]["chunk_ids"] == ["a::c0", "b::c0"]


def test_the_last_call_may_be_unseen(spark):
    t = F.array(F.lit("a"), F.lit("b"))
    got = spark.range(1).select(*(evidence.scored_trace(t, F.lit(x)) for x in ("answered", "max_tool_calls", "budget_exhausted"))).first()
    assert got[:] == (["a", "b"], ["a"], ["a"])


def test_design_sizes_and_order(spark):
    tasks = spark.createDataFrame([("task-eval-000001",), ("task-eval-000002",)], "task_id string")
    assert designs.expand_design(tasks, "exp", 42).count() == 4
    whole = designs.expand_design(tasks, "exp", 42, designs.LIMITS)
    assert whole.count() == 2 * 7 * 2
    import hashlib

    for r in whole.filter("condition = 'vfs'").collect():
        turned = hashlib.sha256(f"42:{r['task_id']}".encode()).digest()[-1] & 1
        assert r["condition_order"] == 1 - turned
    assert designs.pending(whole, whole.filter("condition = 'vfs'")).filter("condition = 'vfs'").count() == 0
    with pytest.raises(ValueError):
        designs.expand_design(tasks, "exp", 42, (3,))
    assert designs.experiment_id(None, "abcdef0123456789", 7) == "exp-abcdef012345-7"


def test_order_checks_cross_their_parts(spark):
    rows = [(p, f"{p:08d}") for p in range(0, 300_000, 1000)]
    rows[150] = (150_000, "00000001")
    rows[200] = (200_000, "00000002")
    got = validation.out_of_order(spark.createDataFrame(rows, "position long, key string"), "key", "position", "order")
    assert sorted(r["key"] for r in got.collect()) == ["00000001", "00000002"]


def test_run_rules(spark):
    bad = record(spark, condition="snippets", tool_call_count=1, tool_calls_by_type=(0, 0, 0, 0), token_accounting=(10, 8, 4, 13, None, None, []), tool_trace=[("a", 2, "read", "{}", True, None, [], False, 1.0)])
    assert {r["rule"] for r in validation.run_violations(bad).collect()} == {"token_total", "token_limit", "calls_by_type", "snippets_without_trace", "ordinals"}


def test_report_refuses_a_mixture(spark):
    made = record(spark, run_key="a", scoring_details=("valid", True), corpus_version="v1").unionByName(record(spark, run_key="b", scoring_details=("valid", False), corpus_version="v1"))
    with pytest.raises(ValueError):
        report.write_report(made, runs.run_frame(made))
    text = report.write_report(made.filter("run_key = 'a'"), runs.run_frame(made.filter("run_key = 'a'")))
    assert "Not run" in text and "## By condition" in text


def test_figures_have_their_columns(frame):
    for name in ("by_hop", "by_tokens", "by_initial_recall"):
        assert set(plots.FIGURES[name](frame).columns) == {"x", "condition", "n", "success_rate"}
    assert len(plots.FIGURES) == 10


def test_trace_examples(spark):
    made = None
    for t, s, v in (("t2", False, True), ("t1", False, True), ("t3", True, False), ("t4", False, False)):
        for c, won in (("snippets", s), ("vfs", v)):
            r = record(spark, run_key=f"{t}:{c}", task_id=t, condition=c, correctness=won, tool_call_count=4, repeated_tool_calls=3 if (t, c) == ("t4", "vfs") else 0)
            made = r if made is None else made.unionByName(r)
    assert {r["example"]: r["run_key"] for r in failures.trace_examples(made).collect()} == {"vfs_win": "t1:vfs", "snippet_win": "t3:snippets", "both_fail": "t4:vfs", "excessive_tool_use": "t4:vfs"}
    assert list(itertools.islice(failures.CLASSES, 1)) == ["initial_retrieval_miss"]


def test_a_report_of_model_runs(spark, sf_dir):
    from textloom.plans.base import nested_runs

    made = nested_runs(spark, sf_dir).cache()
    text = report.write_report(made, runs.run_frame(made), 200)
    titles = [line for line in text.split("\n") if line.startswith("## ")]
    assert titles == ["## By condition", "## Paired test", "## Pairs by stratum", "## By hops and category", "## By share of the budget", "## Intervention", "## Within the file system", "## Failures", "## Examples", "## What this does not say"]
    n = statistics.paired_rates(aggregates.paired(runs.run_frame(made)).select("s_success", "v_success")).first()["n"]
    assert f"[observed] {n} paired tasks" in text and "[inferred]" in text and "vfs_win" in text
    assert report.write_report(made.filter("design_cell = 'primary'"), runs.run_frame(made.filter("design_cell = 'primary'")), 50).count("Not run — no run had a limit") == 1
    assert report.paired_lines({"n": 0, "status": "incomplete_pairs"}) == ["Not run — no complete pairs (incomplete_pairs)."]
