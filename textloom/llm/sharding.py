"""Sharding by weighted rendezvous hashing, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import kept

#: Hex digits of the key's digest that cut a shard into ranges of slots.
RANGE_DIGITS = 3


def _exponential(key: Column, shard: int, weight: float) -> Column:
    """A draw from an exponential law of rate ``weight`` that only key and shard decide."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{shard}|"), key)), 1, 13)
    uniform = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(2**52)
    return -F.log(uniform) / F.lit(float(weight))


def _draws(key: Column, weights: Sequence[float]) -> list[Column]:
    if not weights or min(weights) <= 0:
        raise ValueError("weights: one positive number a shard")
    return [F.struct(_exponential(key, i, w).alias("draw"), F.lit(i).alias("shard")) for i, w in enumerate(weights)]


def _least(draws: Sequence[Column]) -> Column:
    return F.least(*draws) if len(draws) > 1 else draws[0]


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard whose draw is least. Shard ``i`` wins a share ``weights[i] / sum(weights)`` of the keys; as no
    draw depends on the other shards, a new shard takes keys only into itself and a dropped one frees only its own."""
    return _least(_draws(key, weights))["shard"]


def shard_documents(docs: DataFrame, weights: Sequence[float], new_weight: float = 1.0) -> DataFrame:
    """Put every row of ``docs`` (doc_id, text) into a shard and give it a slot there.

    Returns doc_id, size (UTF-8 bytes of the text, none for null, plus 1), text_crc32, law ``key``, shard, slot
    (gapless from 0 in each shard, in the order of a digest of key, size and text_crc32) and grown_shard, the shard with one more
    shard of ``new_weight``. Rows with one doc_id share their shard and get slots of their own; a null doc_id is a
    key like any other. An empty table gives no rows. Other columns of ``docs`` are left out.

    No shard's rows meet in one task for the slots: ranges of digests are numbered on their own, from the
    counts of the ranges before.
    """
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), key.alias("_key"))
    *own, new = _draws(F.col("_key"), [*weights, new_weight])
    # rows that agree in all that is returned are one record until they get their slots
    records = rows.groupBy("doc_id", "size", "text_crc32", "_key").agg(F.count(F.lit(1)).alias("_rows"))
    digest = F.md5(F.concat_ws("|", "_key", "size", "text_crc32"))
    records = kept(records.withColumn("_own", _least(own)).select("doc_id", "size", "text_crc32", "_rows", F.col("_own.shard").alias("shard"), F.least(F.col("_own"), new)["shard"].alias("grown_shard"), digest.alias("_digest")))
    records = records.withColumn("_range", F.substring("_digest", 1, RANGE_DIGITS))
    before = F.sum("count").over(Window.partitionBy("shard").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = records.groupBy("shard", "_range").agg(F.sum("_rows").alias("count")).select("shard", "_range", F.coalesce(before, F.lit(0)).alias("_start"))
    in_range = F.sum("_rows").over(Window.partitionBy("shard", "_range").orderBy("_digest", "doc_id").rowsBetween(Window.unboundedPreceding, -1))
    first = F.col("_start") + F.coalesce("_nth", F.lit(0))
    return (
        records.withColumn("_nth", in_range)
        .join(starts, ["shard", "_range"])
        .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.explode(F.sequence(first, first + F.col("_rows") - 1)).alias("slot"), "grown_shard")
    )
