"""Paired tests, strata and the regression within one condition."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators.aggregates import paired
from textloom.sources.scratch import stored

RESAMPLES, SEED, CONFIDENCE = 10_000, 20250308, 0.95
#: Bytes of the index matrix that a bootstrap holds at once.
HELD = 1 << 24
#: Halves of the generator's steps in a block of the parallel bootstrap, and pairs that are drawn by their places at most.
DRAWN, INDEXED = 1 << 22, 1 << 24
#: Buckets of a pass of selection, and rows that an interval is sorted with on the driver.
PIVOTS, NEAR = 64, 1 << 14


def exact_mcnemar(b: Column, c: Column) -> Column:
    """Two-sided binomial test on the discordant pairs; 1 without any. Terms are summed as logs, so no power underflows."""
    n, k = (b + c).cast("double"), F.least(b, c)
    # log of each binomial coefficient from the one before
    start = F.struct(F.lit(0.0).alias("log"), F.exp(-n * math.log(2)).alias("sum"))

    def add(s: Column, i: Column) -> Column:
        log = s["log"] + F.log(n - i + 1) - F.log(i.cast("double"))
        return F.struct(log.alias("log"), (s["sum"] + F.exp(log - n * math.log(2))).alias("sum"))

    steps = F.when(k > 0, F.sequence(F.lit(1), k.cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.when(n == 0, F.lit(1.0)).when(2 * k == n, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * F.aggregate(steps, start, add)["sum"]))


def paired_rates(pairs: DataFrame, *by: str) -> DataFrame:
    """n, success counts and rates of both sides, difference, discordant counts and the exact test of ``pairs`` (s_success, v_success)."""
    s, v = F.col("s_success"), F.col("v_success")
    g = pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(s).alias("snippets_successes"), F.count_if(v).alias("vfs_successes"), F.count_if(s & ~v).alias("snippets_only"), F.count_if(v & ~s).alias("vfs_only"))
    rate = lambda c: F.try_divide(F.col(c), F.col("n"))
    g = g.withColumns({"snippets_success_rate": rate("snippets_successes"), "vfs_success_rate": rate("vfs_successes")})
    return g.withColumns({"difference": F.try_divide(F.col("vfs_successes") - F.col("snippets_successes"), F.col("n")), "mcnemar_p_value": exact_mcnemar(F.col("snippets_only"), F.col("vfs_only"))})


def bootstrap_interval(differences: np.ndarray, resamples: int = RESAMPLES, seed: int = SEED, confidence: float = CONFIDENCE) -> tuple[float, float]:
    """Percentile interval of the mean, with indices drawn row by row as one matrix would be."""
    rng, n = np.random.default_rng(seed), len(differences)
    means, rows = np.empty(resamples), max(1, HELD // (8 * max(1, n)))
    for lo in range(0, resamples, rows):
        k = min(rows, resamples - lo)
        means[lo : lo + k] = differences[rng.integers(0, n, size=(k, n))].mean(axis=1)
    edge = 50 * (1 - confidence)
    low, high = np.percentile(means, (edge, 100 - edge))
    return float(low), float(high)


def interval_from_counts(lost: int, same: int, won: int, resamples: int = RESAMPLES, seed: int = SEED, confidence: float = CONFIDENCE) -> tuple[float, float]:
    """The interval that ``bootstrap_interval`` estimates, from the numbers of differences -1, 0 and 1 alone: a resample's counts are
    multinomial. Other random numbers, the same law."""
    n = lost + same + won
    drawn = np.random.default_rng(seed).multinomial(n, [lost / n, same / n, won / n], size=resamples)
    edge = 50 * (1 - confidence)
    low, high = np.percentile((drawn[:, 2] - drawn[:, 0]) / n, (edge, 100 - edge))
    return float(low), float(high)


def _accepted(seed: int, n: int, block: int) -> np.ndarray:
    """The numbers below ``n`` that block ``block`` of a seeded generator's stream gives, in order.

    A generator makes 64 bits a step, of which a bounded draw takes the lower and then the upper half; the product of a half with ``n`` has the draw in
    its upper 32 bits, and is thrown away where its lower 32 are below ``2^32 mod n``. The generator jumps to any step at once."""
    bits = np.random.PCG64(seed)
    bits.advance(block * (DRAWN // 2))
    raw = bits.random_raw(DRAWN // 2)
    product = np.stack([raw & np.uint64(0xFFFFFFFF), raw >> np.uint64(32)], axis=1).ravel() * np.uint64(n)
    return (product >> np.uint64(32))[(product & np.uint64(0xFFFFFFFF)) >= np.uint64((1 << 32) % n)].astype(np.int64)


def bootstrap_sums(spark: SparkSession, differences: np.ndarray, resamples: int = RESAMPLES, seed: int = SEED) -> DataFrame:
    """nth, total: the sum of each resample of ``differences`` (small whole numbers), with the indices that one seeded matrix would have.

    The matrix is drawn in blocks of the generator's stream, by as many tasks as there are blocks. As some draws are thrown away, a first pass counts
    what each block keeps, which tells where in the matrix its draws belong; a number a block comes to the driver. Sums of whole numbers are
    exact in any order."""
    n, size = len(differences), len(differences) * resamples
    if n < 2:
        return spark.range(resamples).select(F.col("id").alias("nth"), F.lit(float(differences.sum())).alias("total"))
    held = spark.sparkContext.broadcast(differences.astype(np.int8))  # INDEXED bytes at most
    kept: list[int] = []
    while sum(kept) < size:
        lacking = size - sum(kept)
        more = -(-int(lacking * (1 + 2 * n / (1 << 32))) // DRAWN) + 1
        blocks = spark.range(len(kept), len(kept) + more, 1, min(more, 1024))
        count = lambda batches: (pd.DataFrame({"id": b["id"], "kept": [len(_accepted(seed, n, k)) for k in b["id"].tolist()]}) for b in batches)
        kept += [r["kept"] for r in sorted(blocks.mapInPandas(count, "id long, kept long").collect())]
    starts = np.concatenate([[0], np.cumsum(kept)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k, start in zip(b["id"].tolist(), b["start"].tolist(), strict=True):
                drawn = held.value[_accepted(seed, n, k)[: max(0, size - start)]].astype(np.int64)
                if len(drawn):
                    first, last = start // n, (start + len(drawn) - 1) // n
                    edges = np.maximum(np.arange(first, last + 1) * n - start, 0)
                    yield pd.DataFrame({"nth": np.arange(first, last + 1), "part": np.add.reduceat(drawn, edges)})

    plan = spark.createDataFrame(pd.DataFrame({"id": np.arange(len(kept)), "start": starts[:-1]})).repartition(min(len(kept), 1024))
    return plan.mapInPandas(run, "nth long, part long").groupBy("nth").agg(F.sum("part").cast("double").alias("total"))


def _in_order(pairs: DataFrame) -> np.ndarray:
    """The differences of ``pairs`` (task_id, d) in the order of ids: sorted by ranges, each of which hands on its bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"d": [b["d"].to_numpy().astype(np.int8).tobytes()]})

    sorted_ = pairs.repartitionByRange("task_id").sortWithinPartitions("task_id").mapInPandas(run, "d binary")
    return np.frombuffer(b"".join(bytes(r["d"]) for r in sorted_.collect()), np.int8)


def paired_summary(frame: DataFrame, resamples: int = RESAMPLES, seed: int = SEED, confidence: float = CONFIDENCE, by_index: bool = True) -> DataFrame:
    """One row: ``paired_rates`` of all primary pairs with ci_lower and ci_upper, resamples and seed. With ``by_index`` the bootstrap
    draws rows by their places in the order of ids, as one seeded matrix would, in parallel (see ``bootstrap_sums``); tasks hold a byte a pair, so
    that is done for up to ``INDEXED`` pairs. Beyond, and without ``by_index``, it draws the three counts, which have the same law."""
    if resamples < 1:
        raise ValueError("resamples must be positive")
    spark = frame.sparkSession
    pairs = paired(frame).select("task_id", "s_success", "v_success").filter("s_success is not null and v_success is not null")
    rates = stored(paired_rates(pairs))
    n, won, lost = rates.select("n", "vfs_only", "snippets_only").first()
    low = high = None
    if by_index and 0 < n <= INDEXED:
        d = _in_order(pairs.select("task_id", (F.col("v_success").cast("tinyint") - F.col("s_success").cast("tinyint")).cast("tinyint").alias("d")))
        means = bootstrap_sums(spark, d, resamples, seed).toPandas()["total"].to_numpy() / n  # a number a resample
        low, high = map(float, np.percentile(means, (50 * (1 - confidence), 100 - 50 * (1 - confidence))))
    elif n:
        low, high = interval_from_counts(lost, n - won - lost, won, resamples, seed, confidence)
    return rates.withColumns({"ci_lower": F.lit(low).cast("double"), "ci_upper": F.lit(high).cast("double"), "resamples": F.lit(resamples), "seed": F.lit(seed)})


def exact_quantiles(df: DataFrame, column: str, shares: Sequence[float]) -> list[float] | None:
    """Exact quantiles of a numeric column's values, interpolated as ``percentile`` does, or None if it has none.

    Each rank that is asked for is known to lie between two values. A pass takes pivots in between from a sketch, counts what lies between neighbours
    among them, and goes on with the one interval that holds the rank; values of at most ``NEAR`` rows then come to the driver. Each task keeps
    counts for the pivots, whatever the number of different values, and the intervals shrink by about the number of pivots a pass."""
    x = F.col(column).cast("double")
    values = df.select(x.alias("x")).filter("x is not null")
    n, low, high = values.agg(F.count(F.lit(1)), F.min("x"), F.max("x")).first()
    if not n:
        return None
    ranks = sorted({f(share * (n - 1)) for share in shares for f in (math.floor, math.ceil)})
    found: dict[int, float] = {}
    #: Interval (both ends belong to it), rows below it, rows in it: of several ranks.
    open_: dict[tuple[float, float, int, int], list[int]] = {(low, high, 0, n): ranks}
    while open_:
        narrower: dict[tuple[float, float, int, int], list[int]] = {}
        for (low, high, below, held), own in open_.items():
            inside = values.filter(F.col("x").between(low, high))
            if low == high:
                found |= dict.fromkeys(own, low)
            elif held <= NEAR:
                some = np.sort(inside.toPandas()["x"].to_numpy())
                found |= {k: float(some[k - below]) for k in own}
            else:
                cuts = inside.agg(F.percentile_approx("x", [i / PIVOTS for i in range(1, PIVOTS)], 10_000)).first()[0]
                pivots = F.lit(sorted({low, *cuts, high}))
                bucket = F.array_size(F.filter(pivots, lambda p: p < F.col("x")))  # values equal to a pivot end its bucket
                counts = inside.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).orderBy("b").collect()
                for r in counts:
                    if mine := [k for k in own if below <= k < below + r["n"]]:
                        key = (r["low"], r["high"], below, r["n"])
                        if key[3] == held:  # one bucket holds all: only its ends are told apart
                            ends = values.agg(F.count_if(F.col("x") == key[0]), F.count_if(F.col("x") == key[1])).first()
                            found |= {k: key[0] for k in mine if k < below + ends[0]} | {k: key[1] for k in mine if k >= below + held - ends[1]}
                            mine = [k for k in mine if k not in found]
                            inner = values.filter((F.col("x") > key[0]) & (F.col("x") < key[1])).agg(F.min("x"), F.max("x")).first()
                            key = (inner[0], inner[1], below + ends[0], held - ends[0] - ends[1])
                        if mine:
                            narrower.setdefault(key, []).extend(mine)
                    below += r["n"]
        open_ = narrower
    out = []
    for share in shares:
        at = share * (n - 1)
        lower, upper = math.floor(at), math.ceil(at)
        a, b = found[lower], found[upper]
        out.append(a if lower == upper or a == b else (upper - at) * a + (at - lower) * b)
    return out


def recall_band(recall: Column) -> Column:
    return F.when(recall == 0, "0").when(recall == 1, "1").when((recall > 0) & (recall < 1), "(0,1)")


def token_quartile(tokens: Column, edges: Column) -> Column:
    """The quartile's name: one more than the inner edges that are at most the value, so a value on an edge is above it. Equal edges are one."""
    inner = F.slice(edges, 2, F.greatest(F.size(edges) - 2, F.lit(0)))
    return F.when(tokens.isNotNull(), F.concat(F.lit("q"), (F.size(F.filter(inner, lambda e: e <= tokens)) + 1).cast("string")))


def stratified(frame: DataFrame) -> DataFrame:
    """Paired rates of the primary pairs whose sides are in one band, per band of token quartile, recall, hops and category: stratum, band, n,
    rates, difference, mcnemar_p_value, missing_reason. Bands that exist but have no pair stay, with n 0."""
    pairs = paired(frame)
    both = lambda c: F.array(F.col(f"s_{c}"), F.col(f"v_{c}"))
    each = pairs.select(F.explode(both("total_tokens")).alias("t")).filter("t is not null")
    cuts = exact_quantiles(stored(each), "t", (0, 0.25, 0.5, 0.75, 1))
    edges = frame.sparkSession.range(1).select((F.lit(None) if cuts is None else F.array(*map(F.lit, dict.fromkeys(cuts)))).cast("array<double>").alias("edges"))
    p = pairs.crossJoin(F.broadcast(edges))  # one row
    bands = {
        "token_quartile": lambda side: token_quartile(F.col(f"{side}_total_tokens").cast("double"), F.col("edges")),
        "recall_band": lambda side: recall_band(F.col(f"{side}_initial_recall")),
        "hop": lambda side: F.col(f"{side}_hop_count").cast("string"),
        "category": lambda side: F.nullif(F.btrim(f"{side}_category"), F.lit("")),
    }
    stacked = F.explode(F.array(*(F.struct(F.lit(k).alias("stratum"), f("s").alias("s_band"), f("v").alias("v_band")) for k, f in bands.items())))
    wide = p.select("s_success", "v_success", stacked.alias("b")).select("s_success", "v_success", "b.*")
    rates = paired_rates(wide.filter("s_band = v_band").withColumnRenamed("s_band", "band"), "stratum", "band")
    seen = wide.select("stratum", F.explode(F.array("s_band", "v_band")).alias("band")).filter("band is not null and stratum in ('hop', 'category')").distinct()
    quartiles = edges.select(F.lit("token_quartile").alias("stratum"), F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.coalesce(F.size("edges"), F.lit(1)) - 1)), lambda i: F.concat(F.lit("q"), i.cast("string")))).alias("band"))
    recalls = frame.sparkSession.createDataFrame([("recall_band", b) for b in ("0", "(0,1)", "1")], "stratum string, band string")
    levels = seen.unionByName(quartiles).unionByName(recalls)
    out = levels.join(rates, ["stratum", "band"], "left")
    reason = F.when(F.col("n").isNull(), "no within-band pairs")
    return out.select("stratum", "band", F.coalesce("n", F.lit(0)).alias("n"), "snippets_success_rate", "vfs_success_rate", "difference", "mcnemar_p_value", reason.alias("missing_reason"))


TERMS = ("intercept", "calls", "calls_squared", "initial_recall", "hops", "tokens", "distractors")
FITTED = "term string, coefficient double, std_error double, ci_lower double, ci_upper double, p_value double, converged boolean, error string, n long, reference_category string, status string"


def logit_sums(x: np.ndarray, y: np.ndarray, beta: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, float]:
    """One part's share of a step of reweighted least squares at ``beta`` (None: the usual start): XᵀWX, XᵀWz and the deviance."""
    if beta is None:
        mean = (y + 0.5) / 2
        eta = np.log(mean / (1 - mean))
    else:
        eta = x @ beta
        mean = np.clip(1 / (1 + np.exp(-eta)), 1e-12, 1 - 1e-12)
        eta = np.log(mean / (1 - mean))
    w = mean * (1 - mean)
    z = eta + (y - mean) / w
    return x.T @ (x * w[:, None]), x.T @ (w * z), -2 * float(np.sum(y * np.log(mean) + (1 - y) * np.log(1 - mean)))


def meat_sums(x: np.ndarray, y: np.ndarray, beta: np.ndarray, bread: np.ndarray) -> np.ndarray:
    """One part's share of the middle of the HC3 covariance."""
    mean = np.clip(1 / (1 + np.exp(-(x @ beta))), 1e-12, 1 - 1e-12)
    hat = mean * (1 - mean) * np.einsum("ij,jk,ik->i", x, bread, x)
    part = x * ((y - mean) / np.maximum(1e-12, 1 - hat))[:, None]
    return part.T @ part


def fit_logit(sums: Callable[[np.ndarray | None], tuple[np.ndarray, np.ndarray, float]], meat: Callable[[np.ndarray, np.ndarray], np.ndarray], most: int = 100, tolerance: float = 1e-8) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients and HC3 covariance of a binomial model with logit link, by reweighted least squares on sums over all rows
    (``logit_sums``, ``meat_sums``), wherever these lie."""
    beta, old = None, np.inf
    for _ in range(most + 1):
        gram, right, deviance = sums(beta)
        if beta is not None and abs(old - deviance) < tolerance:
            break
        old = deviance if beta is not None else np.inf
        # columns of very different size, as calls and tokens, are brought to one before the inverse is taken
        scale = 1 / np.sqrt(np.maximum(np.diag(gram), 1e-300))
        beta = scale * (np.linalg.pinv(gram * np.outer(scale, scale), rcond=1e-12, hermitian=True) @ (scale * right))
    else:
        raise RuntimeError("did not converge")
    bread = np.outer(scale_ := 1 / np.sqrt(np.maximum(np.diag(gram), 1e-300)), scale_) * np.linalg.pinv(gram * np.outer(scale_, scale_), rcond=1e-12, hermitian=True)
    return beta, bread @ meat(beta, bread) @ bread


NEED = {"success": "correctness", "tool_call_count": "calls", "initial_recall": "initial recall", "hop_count": "hops", "total_tokens": "tokens", "distractor_count": "distractors", "category": "category"}


def design(g: pd.DataFrame, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    calls = g["tool_call_count"].astype(float).to_numpy()
    category = g["category"].str.strip()
    columns = [np.ones(len(g)), calls, calls**2, *(g[c].astype(float).to_numpy() for c in ("initial_recall", "hop_count", "total_tokens", "distractor_count")), *((category == c).astype(float).to_numpy() for c in names[1:])]
    return np.stack(columns, axis=1), g["success"].astype(float).to_numpy()


def _status(why: str | None, n: int, reference: str | None, status: str) -> tuple:
    return ("__status__", None, None, None, None, None, why is None, why, n, reference, status)


def within_vfs_regression(frame: DataFrame, confidence: float = CONFIDENCE) -> DataFrame:
    """Success on calls, their square, recall, hops, tokens, distractors and category over the primary file-system runs; an association, not a
    cause. Every step sums small matrices over the partitions; no task holds all runs, and a row a partition comes to the driver. Where there
    is no model a status row says why."""
    if not 0 < confidence < 1:
        raise ValueError("confidence must be between zero and one")
    rows = frame.filter((F.col("design_cell") == "primary") & (F.col("condition") == "vfs")).select("task_id", *NEED)
    rows = stored(rows.withColumns({"success": F.col("success").cast("int"), "category": F.btrim("category")}))
    again = rows.groupBy("task_id").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("again"))
    about = rows.agg(
        F.count(F.lit(1)).alias("n"), *(F.count_if(F.col(c).isNull()).alias(f"no_{c}") for c in NEED), F.array_sort(F.collect_set("category")).alias("names"), F.count_distinct("success").alias("outcomes"),
        F.count_if(~F.coalesce(F.col("initial_recall").between(0, 1), F.lit(True))).alias("outside"),
    ).crossJoin(F.broadcast(again)).first()  # fmt: skip  one row each
    n, names = about["n"], list(about["names"])
    terms = [*TERMS, *(f"category_{c}" for c in names[1:])]
    lacking = [name for c, name in NEED.items() if about[f"no_{c}"]]
    if about["again"] > 1:
        out = [_status("a task stands twice", n, None, "error")]
    elif lacking:
        out = [_status("covariates are missing: " + ", ".join(lacking), n, None, "error")]
    elif about["outside"]:
        out = [_status("initial recall is out of range", n, names[0], "error")]
    elif about["outcomes"] < 2:
        out = [_status("both outcomes are needed", n, names[0] if names else None, "error")]
    elif n <= len(terms):
        out = [_status("too few runs for the terms", n, names[0], "error")]
    else:
        out = _estimates(rows, terms, names, n, confidence)
    made = frame.sparkSession.createDataFrame(out, FITTED)
    return made.withColumns({"associative": F.lit(True), "covariance_type": F.lit("HC3")})


def _summed(rows: DataFrame, names: list[str], part: Callable[[np.ndarray, np.ndarray], list[np.ndarray]]) -> np.ndarray:
    """The sum over all partitions of the numbers that ``part`` makes of a batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for g in batches:
            if len(g):
                flat = np.concatenate([np.ravel(v) for v in part(*design(g, names))])
                total = flat if total is None else total + flat
        if total is not None:
            yield pd.DataFrame({"k": np.arange(len(total)), "v": total})

    got = rows.mapInPandas(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).orderBy("k").toPandas()
    return got["v"].to_numpy()


def _estimates(rows: DataFrame, terms: list[str], names: list[str], n: int, confidence: float) -> list[tuple]:
    k = len(terms)

    def sums(beta: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, float]:
        v = _summed(rows, names, lambda x, y: list(logit_sums(x, y, beta)))
        return v[: k * k].reshape(k, k), v[k * k : k * k + k], float(v[-1])

    def meat(beta: np.ndarray, bread: np.ndarray) -> np.ndarray:
        return _summed(rows, names, lambda x, y: [meat_sums(x, y, beta, bread)]).reshape(k, k)

    try:
        beta, cov = fit_logit(sums, meat)
        error = np.sqrt(np.diag(cov))
        if not np.isfinite(beta).all() or not np.isfinite(error).all() or (error == 0).any():
            raise ValueError("an estimate is not finite")
    except (ValueError, RuntimeError, np.linalg.LinAlgError) as e:
        return [_status(f"{type(e).__name__}: {e}", n, names[0], "error")]
    z = NormalDist().inv_cdf((1 + confidence) / 2)
    out = [(t, b, s, b - z * s, b + z * s, math.erfc(abs(b / s) / math.sqrt(2)), True, None, n, names[0], "coefficient") for t, b, s in zip(terms, beta.tolist(), error.tolist(), strict=True)]
    return [*out, _status(None, n, names[0], "converged")]
