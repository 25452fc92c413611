"""Mixing sources to target weights by a temperature, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, fresh, kept, stored, told

#: Halvings of the exponent's interval.
STEPS = 40
#: Hex digits of a record's digest that cut an epoch into ranges.
RANGE_DIGITS = 3
#: Records without words that share a block, at most on average; where there are more, they get further blocks.
BLOCK_RECORDS = 1 << 16


def record_key(docs: DataFrame) -> Column:
    """Rows that agree in doc_id, source and text are one record; a null is a value of its own, which no text is."""
    return F.md5(F.concat(told(F.col("doc_id")), told(F.col("source")), told(F.md5(F.col("text").cast("string")))))


def source_weights(totals: DataFrame, max_repeats: float = 2.0, target_entropy: float | None = None, budget: int | None = None) -> DataFrame:
    """Weights of sources from their token totals (source, tokens).

    A source's weight is its token share to the power of ``exponent``, normalised. The exponent, from 0 (equal
    weights) to 1 (the shares as they are), is bisected: with ``target_entropy`` (a share of the log of the
    number of sources) to the greatest exponent whose weights reach it; else to the least exponent with which no
    source is read more than ``max_repeats`` times. ``budget``: tokens of the mixture; None: as many as let each source be read once
    at least, so that no document is left out. Sources without tokens have weight 0.
    Returns source, tokens, exponent, weight, quota (tokens), repeats.
    """
    sources = F.sort_array(F.collect_list(F.when(F.col("tokens") > 0, F.col("tokens").cast("double"))))
    one = totals.agg(sources.alias("n"))
    add = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    total = add(F.col("n"))
    shares = F.transform("n", lambda x: x / F.try_element_at("n", F.lit(-1)))
    one = one.withColumn("q", shares).withColumn("total", total)

    def fits(a: Column) -> Column:
        powers = add(F.transform("q", lambda x: F.pow(x, a)))
        if target_entropy is not None:
            mean_log = add(F.transform("q", lambda x: F.pow(x, a) * a * F.log(x)))
            return F.log(powers) - mean_log / powers < F.lit(target_entropy) * F.log(F.size("q").cast("double"))
        least = F.try_element_at("q", F.lit(1))  # repeats of the smallest source, the most
        if budget is None:
            return F.pow(least, a - 1) <= F.lit(float(max_repeats))
        return F.lit(float(budget)) * F.pow(least, a) / powers <= F.lit(float(max_repeats)) * least * F.try_element_at("n", F.lit(-1))

    start = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = (s["lo"] + s["hi"]) / 2
        ok = fits(mid)
        return F.struct(F.when(ok, s["lo"]).otherwise(mid).alias("lo"), F.when(ok, mid).otherwise(s["hi"]).alias("hi"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, halve)
    exponent = F.when(fits(F.lit(0.0)), F.lit(0.0)).otherwise(F.round(found["hi"], 9))
    one = one.withColumn("exponent", F.when(F.size("n") > 0, exponent).otherwise(F.lit(1.0)))
    powers = add(F.transform("q", lambda x: F.pow(x, F.col("exponent"))))
    size = F.lit(float(budget)) if budget is not None else F.try_element_at("n", F.lit(-1)) * F.col("powers")
    one = one.withColumn("powers", powers).select("exponent", "powers", F.try_element_at("n", F.lit(-1)).alias("most"), size.alias("size"))
    out = totals.crossJoin(F.broadcast(one))  # one row
    weight = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.col("most"), F.col("exponent")) / F.col("powers")).otherwise(F.lit(0.0))
    quota = F.when(F.col("tokens") > 0, F.greatest(F.round(F.col("size") * F.col("weight")), F.lit(1.0))).otherwise(F.lit(0.0)).cast("long")
    if budget is None:
        quota = F.greatest(quota, F.col("tokens"))
    out = out.withColumn("weight", weight).withColumn("quota", quota)
    return out.select("source", "tokens", "exponent", "weight", "quota", F.try_divide("quota", "tokens").alias("repeats"))


def mix(docs: DataFrame, max_repeats: float = 2.0, target_entropy: float | None = None, budget: int | None = None, block_tokens: int = 1 << 20, seed: str = "mix") -> DataFrame:
    """Realise the weights of ``source_weights`` over ``docs`` (doc_id, source, text) as permuted blocks.

    Tokens are words. A source is read in epochs, each in an order of its own that ``seed``, epoch and record
    decide, up to its quota: whole documents, the last one begun counts. The mixture is cut into about
    ``sum of quotas / block_tokens`` blocks; each holds the same share of every source's quota and is shuffled.
    Returns key, doc_id, source, tokens, copies, epoch (from 0), block (from 0), slot (from 0 in its block).

    Repeated rows (same doc_id, source and text) are one record with ``copies`` of them. A null source is a source.
    Records without words go with the first epoch, in a block that their digest decides; very many of them get blocks of their own. An empty
    table gives no rows. Other columns are left out. Positions within an epoch come from ranges of digests that
    are summed on their own, so a source with a third of the rows is never in one task; texts are not shuffled.
    """
    rows = docs.select(record_key(docs).alias("key"), "doc_id", "source", told(F.col("source")).alias("_source"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("tokens"))
    records = kept(rows.groupBy("key").agg(*(F.first(c).alias(c) for c in ("doc_id", "source", "_source", "tokens")), F.count(F.lit(1)).alias("copies")))
    totals = records.groupBy(F.col("_source").alias("source")).agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"))
    weights = stored(source_weights(totals, max_repeats, target_entropy, budget))
    shape = weights.agg(F.greatest(F.lit(1), F.ceil(F.sum("quota") / F.lit(float(block_tokens)))).cast("long").alias("blocks"))
    rooms = F.greatest(F.lit(1), F.ceil(F.count_if(F.col("tokens") == 0) / F.lit(float(BLOCK_RECORDS)))).cast("long")
    shape = shape.crossJoin(F.broadcast(records.agg(rooms.alias("rooms"))))  # one row
    # a row a source: where these are few, the join knows their size and leaves the records in their places
    w = stored(weights.select(F.col("source").alias("_source"), F.col("tokens").alias("all_tokens"), "quota").crossJoin(F.broadcast(shape)))  # one row
    epochs = F.greatest(F.lit(1), F.ceil(F.col("quota") / F.greatest(F.col("all_tokens"), F.lit(1)))).cast("int")
    order = F.md5(F.concat_ws("|", F.lit(seed), F.col("epoch").cast("string"), F.col("key")))
    read = records.join(w, "_source").withColumn("epoch", F.explode(F.sequence(F.lit(0), epochs - 1))).withColumn("order", order)
    read = read.withColumn("range", F.substring("order", 1, RANGE_DIGITS)).withColumn("load", F.col("tokens") * F.col("copies"))
    sums = read.groupBy("_source", "epoch", "range").agg(F.sum("load").alias("load"))
    before = F.sum("load").over(Window.partitionBy("_source", "epoch").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    starts = sums.select("_source", "epoch", "range", F.coalesce(before, F.lit(0)).alias("start"))
    within = F.sum("load").over(Window.partitionBy("_source", "epoch", "range").orderBy("order", "key").rowsBetween(Window.unboundedPreceding, -1))
    at = F.col("epoch") * F.col("all_tokens") + F.col("start") + F.coalesce(F.col("within"), F.lit(0))
    placed = read.withColumn("within", within).join(starts, ["_source", "epoch", "range"]).withColumn("at", at)
    placed = placed.filter((F.col("at") < F.col("quota")) | ((F.col("epoch") == 0) & (F.col("tokens") == 0)))
    # records without words take up no room: any block will do, of as many as keep each bounded
    block = F.when(F.col("tokens") == 0, F.pmod(F.conv(F.substring("order", 1, 8), 16, 10).cast("long"), F.greatest("blocks", "rooms"))).otherwise(F.least(F.floor(F.col("at") * F.col("blocks") / F.greatest(F.col("quota"), F.lit(1))), F.col("blocks") - 1)).cast("long")
    slot = F.row_number().over(Window.partitionBy("block").orderBy(F.reverse("order"), "key")) - 1
    return placed.withColumn("block", block).select("key", "doc_id", "source", "tokens", "copies", "epoch", "block", slot.cast("long").alias("slot"))


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` (doc_id, source, text and any others), with all their columns, as often as ``mix`` takes them: repeated
    rows each as often as their record, null sources as a source, rows without words once; an empty table gives no rows."""
    key = fresh(docs, "record_key")
    taken = mix(docs, **how).select(F.col("key").alias(key))
    return docs.withColumn(key, record_key(docs)).join(taken, key).select(*(F.col(f"`{c}`") for c in docs.columns))
