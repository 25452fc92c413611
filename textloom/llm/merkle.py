"""A manifest of a dataset as a tree of digests: leaves by group in order, runs of three as parents, up to one root."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored

#: Nodes of one parent, and levels of paths between two stored tables.
ARITY, LEVELS = 3, 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def encoded(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value; integers in decimal."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(text: Column) -> Column:
    return F.sha2(F.concat(*(encoded(text if c == "text" else F.col(c)) for c in FIELDS)), 256)


def _numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``node``, their place from 0 in their ``group`` by ``order``, and ``nodes``, how many the group has.

    Rows are dealt out and sorted by range, so that a group's rows lie in as many tasks as they need; a row's place is its place in its
    range after all rows of the ranges before. ``order`` has to tell all rows apart for a group of equal rows to be split."""
    ranged = rows.repartitionByRange("group", *order).sortWithinPartitions("group", *order)
    ranged = stored(ranged.withColumn("_at", F.monotonically_increasing_id()))  # in a range, ids are consecutive in its order
    part = F.shiftright("_at", 33)
    ranges = ranged.groupBy("group", part.alias("_part")).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    own = Window.partitionBy("group")
    before = F.sum("_rows").over(own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    ranges = ranges.select("group", "_part", "_first", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_rows").over(own).alias("nodes"))
    numbered = ranged.withColumn("_part", part).join(ranges, ["group", "_part"])
    return numbered.withColumn("node", F.col("_at") - F.col("_first") + F.col("_before")).drop("_at", "_part", "_first", "_before")


def _tree(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The levels of the trees over ``nodes`` (group, node, nodes, digest, and more that the lowest level keeps), as stored tables, and what
    remains of each group: group, depth, digest. A level has, of each node, its parent's number and ``before`` and ``after``, the
    digests of its siblings on either side."""
    nodes = stored(nodes)
    most = nodes.agg(F.coalesce(F.max("nodes"), F.lit(0))).first()[0]
    remain = nodes.filter("nodes = 1").select("group", F.lit(0).alias("depth"), "digest")
    levels: list[DataFrame] = []
    while most > 1:
        run = Window.partitionBy("group", "parent").orderBy("node").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        level = nodes.filter("nodes > 1").withColumn("parent", F.expr(f"node div {ARITY}")).withColumn("run", F.collect_list("digest").over(run))
        own = (F.col("node") % ARITY + 1).cast("int")
        beside = {"before": F.array_join(F.slice("run", F.lit(1), own - 1), ""), "after": F.array_join(F.slice("run", own + 1, F.lit(ARITY)), "")}
        level = level.withColumns(beside | {"up": F.when(own == 1, F.sha2(F.array_join("run", ""), 256))}).drop("run", "digest")
        levels.append(stored(level))
        # a parent comes once, from its first child
        nodes = levels[-1].filter("up is not null").select("group", F.col("parent").alias("node"), F.ceil(F.col("nodes") / ARITY).alias("nodes"), F.col("up").alias("digest"))
        most = -(-most // ARITY)
        remain = remain.unionByName(nodes.filter("nodes = 1").select("group", F.lit(len(levels)).alias("depth"), "digest"))
    return levels, stored(remain)


def _with_paths(leaves: DataFrame, levels: list[DataFrame], tops: DataFrame, own: list[str]) -> DataFrame:
    """``own`` columns of all ``leaves`` with ``path``, the siblings on the way up, and what ``tops`` (group, depth, path, and more) say of their group.

    Paths go down: a node's is its own siblings before its parent's. So each level joins the one above, a third of its size, by
    group and parent, and no leaf is joined with every level."""
    said = [c for c in tops.columns if c not in ("group", "depth")]
    at = lambda depth: tops.filter(F.col("depth") == depth).select("group", F.lit(0).cast("long").alias("node"), *said)
    above = at(len(levels))
    for depth in range(len(levels) - 1, -1, -1):
        up = above.withColumnRenamed("node", "parent").withColumnRenamed("path", "_path")
        met = levels[depth].join(up, ["group", "parent"])
        path = F.concat(F.array(F.struct("before", "after")), F.col("_path"))
        keep = own if depth == 0 else []
        above = met.select("group", "node", *keep, *(path.alias("path") if c == "path" else c for c in said))
        if depth:
            above = above.unionByName(at(depth))
            above = stored(above) if depth % LEVELS == 0 else above
    lone = leaves.filter("nodes = 1").join(at(0).drop("node"), "group")
    whole = lone.select(*own, *said)
    return above.select(*own, *said).unionByName(whole) if levels else whole


def folded(leaf: Column, path: Column) -> Column:
    """The root that ``leaf`` and the siblings of ``path`` give."""
    return F.aggregate(path, leaf, lambda digest, step: F.sha2(F.concat(step["before"], digest, step["after"]), 256))


def manifest(docs: DataFrame) -> DataFrame:
    """The manifest of ``docs`` (doc_id, source, lang, n_chars, text): all of them with ``leaf``, ``path`` (array of before and after: siblings' digests,
    joined, from the leaf's run to the root's), ``subroot`` of the source, ``root`` of all and ``changed``, the leaf with line ends deleted from the text.

    Leaves of a source are in the order of doc_id (null first); of one doc_id in that of their digests, so that repeated rows are leaves of
    their own, side by side. A null source is a source, before all others; these are in the order of their UTF-8 bytes. Null, empty
    and long texts are values like others; an empty table gives no rows; other columns are left out. The texts are read once and
    never shuffled; a group's leaves are numbered by ranges, and what tasks see together later is a run of three."""
    group = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    own = docs.select(*FIELDS)
    leaves = own.select("doc_id", group.alias("group"), leaf_digest(F.col("text")).alias("digest"), leaf_digest(F.replace("text", F.lit("\n"), F.lit(""))).alias("changed"), F.monotonically_increasing_id().alias("_row"))
    leaves = stored(leaves)  # ranges are found in a pass of their own
    leaves = stored(_numbered(leaves, ["doc_id", "digest", "_row"]).drop("_row").withColumn("leaf", F.col("digest")))
    levels, subroots = _tree(leaves)
    upper = stored(_numbered(subroots.select(F.lit("").alias("group"), F.col("group").alias("source_group"), F.col("depth").alias("source_depth"), "digest").withColumn("subroot", F.col("digest")), ["source_group"]))
    upper_levels, root = _tree(upper)
    root = root.select("group", "depth", F.array().cast("array<struct<before:string,after:string>>").alias("path"), F.col("digest").alias("root"))
    tops = _with_paths(upper, upper_levels, root, ["source_group", "source_depth", "subroot"])
    tops = stored(tops.select(F.col("source_group").alias("group"), F.col("source_depth").alias("depth"), "path", "subroot", "root"))
    return _with_paths(leaves, levels, tops, ["doc_id", "leaf", "changed"])
