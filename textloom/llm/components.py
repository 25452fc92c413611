"""Connected components of a graph that no machine holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Edges of a file between two rounds.
FILE_ROWS = 1 << 18


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def connected_components(edges: DataFrame) -> DataFrame:
    """The least node reachable from each node of ``edges`` (a, b), of any type with an order.

    Returns node, component for every node in an edge with two different ends. Loops, repeated edges and nulls do
    no harm; no edges give no rows.

    Star contraction: in turn every node hands its greater neighbours, then its smaller ones, to the least node
    among itself and its neighbours. Components stay as they are, and after about log2 of the longest path every
    node hangs on its least one. Only minima per node are gathered, so a node with any number of neighbours is
    combined before the shuffle. Rounds are written to the shared folder.
    """
    now = edges.select("a", "b").filter("a is not null and b is not null and a <> b")
    now = stored(now.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    rows = now.count()
    while rows:
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _least(both).select("u", F.least("u", "m").alias("m"))
        # large star: greater neighbours of u go to u's least
        large = both.filter("v > u").join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and its smaller neighbours go to u's least
        small = large.join(_least(large), "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        # no more files than the edges left need
        now = stored(small.filter("u <> v").distinct().repartition(1 + rows // FILE_ROWS))
        # done when every node hangs on one node, which hangs on none
        ends = now.select(F.col("u").alias("x"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).unionByName(now.select(F.col("v").alias("x"), F.lit(0).alias("hangs"), F.lit(1).alias("holds")))
        nodes = ends.groupBy("x").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds"))
        odd, rows = nodes.agg(F.count_if((F.col("hangs") > 1) | ((F.col("hangs") == 1) & (F.col("holds") == 1))), F.coalesce(F.sum("hangs"), F.lit(0))).first()
        if odd == 0:
            break
    roots = now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
