"""Quality rules with thresholds from quantile sketches per language and source, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, let, stored, told, words

SYMBOLS = "[#*$%&|<>]"
#: Retained items at a sketch's lowest level: groups of up to so many rows have exact quantiles, larger ones
#: a rank error of about 2.3 / k.
SKETCH_K = 2048
#: Measures, and whether they have a bound below the quartiles too. Shares are taken as log odds with half a count added, so
#: that rows without any differ by their length and a group whose rows mostly have none still has a spread of its own.
MEASURES = {"word_length": True, "symbol_odds": False, "dup_line_odds": False, "repeat_odds": False}
#: Interquartile ranges from a quartile to its bound: the outer fence of box plots, beyond which values count as far out.
REACH = 3.0
#: Parts that the sketches of a group are merged in.
PARTS = 16
#: Rows' worth of its parent (language, then all rows) that a group's quartiles are blended with.
PRIOR_ROWS = 8


def text_counts(text: Column) -> Column:
    """A struct of n_words, word_chars, n_symbols, n_lines (lines with a word), n_dup_lines, n_repeat_words."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))

    def repeats(h: Column) -> Column:
        """Words in windows whose hash occurs twice: the union of [i, i + 2] over such i."""
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def covered(s: Column) -> Column:
            same = lambda x, j: (F.get(s, j)["h"] == x["h"])
            twice = F.filter(s, lambda x, j: F.coalesce(same(x, j - 1), F.lit(False)) | F.coalesce(same(x, j + 1), F.lit(False)))
            at = F.sort_array(F.transform(twice, lambda x: x["i"]))
            return let(at, lambda a: F.aggregate(F.transform(a, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(a, j + 1) - x, F.lit(3)))), F.lit(0), lambda n, x: n + x))

        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(pairs, covered))

    def of_words(w: Column) -> Column:
        windows = F.transform(F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
        return F.struct(F.size(w).cast("long").alias("n_words"), let(windows, repeats).cast("long").alias("n_repeat_words"))

    counted = let(words(text), of_words)
    of_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")))
    return F.struct(
        counted.alias("w"),
        F.length(F.regexp_replace(text, SPACE, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        of_lines.alias("l"),
    )


def thresholds(measured: DataFrame, reach: float = REACH, prior_rows: float = PRIOR_ROWS) -> DataFrame:
    """lang, source and bounds: for each measure low (null where it has none) and high, ``reach`` interquartile ranges beyond the
    quartiles of the group. A group of ``n`` rows weighs ``n / (n + prior_rows)`` in its quartiles, its language the rest, which is
    blended with all rows alike; so a small group leans on its parent, without a size at which that changes. Each level
    merges the sketches of the level below. Nothing but the rows' own values sets a bound."""
    # each task hands on a sketch a group: those of one group are merged in parts first, however many tasks there are
    parts = measured.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(PARTS))).groupBy("lang", "source", "part")
    parts = parts.agg(F.count(F.lit(1)).alias("n"), *(F.kll_sketch_agg_double(m, F.lit(SKETCH_K)).alias(m) for m in MEASURES))
    merged = [F.sum("n").alias("n"), *(F.kll_merge_agg_double(m, F.lit(SKETCH_K)).alias(m) for m in MEASURES)]
    sketches = stored(parts.groupBy("lang", "source").agg(*merged))
    langs = sketches.groupBy("lang").agg(*merged)
    # all rows: from the languages' sketches, of which there are few
    every = langs.agg(*merged)

    def quartiles(df: DataFrame, at: str) -> DataFrame:
        each = [F.kll_sketch_get_quantile_double(m, F.array(F.lit(0.25), F.lit(0.75))).alias(m) for m in MEASURES]
        keys = [c for c in ("lang", "source") if c in df.columns]
        return df.select(*keys, F.struct(F.col("n").cast("double").alias("n"), *each).alias(at))

    per = quartiles(sketches, "own").join(quartiles(langs, "per_lang"), "lang").crossJoin(F.broadcast(quartiles(every, "all")))  # one row

    def bounds(m: str, below: bool) -> Column:
        def blended(at: str, k: int, parent: Column) -> Column:
            n = F.col(f"{at}.n")
            return (n * F.col(f"{at}.{m}")[k] + F.lit(float(prior_rows)) * parent) / (n + F.lit(float(prior_rows)))

        lo, hi = (blended("own", k, blended("per_lang", k, F.col(f"all.{m}")[k])) for k in (0, 1))
        low = lo - F.lit(reach) * (hi - lo) if below else F.lit(None).cast("double")
        return F.struct(low.alias("low"), (hi + F.lit(reach) * (hi - lo)).alias("high")).alias(m)

    return per.select("lang", "source", F.struct(*(bounds(m, below) for m, below in MEASURES.items())).alias("bounds"))


def judge_quality(docs: DataFrame, reach: float = REACH, prior_rows: float = PRIOR_ROWS) -> DataFrame:
    """Counts and verdict for every row of ``docs`` (doc_id, text, lang, source).

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed (fewer than 50 words,
    or more than half of the words in repeated 3-word windows), kept: not base_failed, and every measure within the
    bounds of its language and source (see ``thresholds``), and outside: the names of the measures beyond their bounds, empty
    if base_failed. Rows that fail the base rule do not enter the sketches, and rows of a group that agree in all counts enter
    them once. Null texts are empty; null lang or
    source are groups of their own, whatever texts name; a group of equal rows keeps them; repeated rows are judged alike; an empty table gives no rows;
    other columns are left out.
    """
    c = docs.select("doc_id", told(F.col("lang")).alias("lang"), told(F.col("source")).alias("source"), text_counts(F.col("text")).alias("c"))
    c = c.select("doc_id", "lang", "source", "c.w.n_words", "c.word_chars", "c.n_symbols", F.col("c.l.n").alias("n_lines"), F.col("c.l.dup").alias("n_dup_lines"), "c.w.n_repeat_words")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    c = stored(c.withColumn("base_failed", failed))
    odds = lambda a, b: F.log((F.col(a) + F.lit(0.5)) / (F.col(b) + F.lit(1.0)))
    length = F.coalesce(F.try_divide(F.col("word_chars").cast("double"), F.col("n_words").cast("double")), F.lit(0.0))
    m = c.withColumns({"word_length": length, "symbol_odds": odds("n_symbols", "word_chars"), "dup_line_odds": odds("n_dup_lines", "n_lines"), "repeat_odds": odds("n_repeat_words", "n_words")})
    # rows that agree in all counts, as copies do, count once: however many, they don't narrow the bounds of others
    distinct = m.filter(~F.col("base_failed")).drop("doc_id").distinct()
    limits = stored(thresholds(distinct, reach, prior_rows))
    beyond = [(F.col(x) > F.col(f"bounds.{x}.high")) | ((F.col(x) < F.col(f"bounds.{x}.low")) if below else F.lit(False)) for x, below in MEASURES.items()]
    outside = F.concat_ws(",", *(F.when(out & ~F.col("base_failed"), F.lit(x)) for x, out in zip(MEASURES, beyond, strict=True)))
    judged = m.join(limits, ["lang", "source"], "left").withColumn("outside", outside)
    kept = ~F.col("base_failed") & (F.col("outside") == "")
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "outside")
