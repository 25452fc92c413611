"""URL rules as a sort-merge range join with a sorted sweep, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import lower_ascii

RULE = "struct<host:string,path:string,action:string>"
#: Rows of pages in a group of the sweep, and parts that the pages of a hot pair of labels are joined in.
GROUP_ROWS, PARTS = 1024, 64


def url_host(url: Column) -> Column:
    return _part(url, 1, lower_ascii)


def url_path(url: Column) -> Column:
    return _part(url, 2, lambda x: x)


def _part(url: Column, group: int, change) -> Column:
    """(?s) lets the scheme hold anything; no match, as without ``://`` or for null, is empty."""
    return F.coalesce(change(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", group)), F.lit(""))


def host_key(host: Column) -> Column:
    """Labels from the top level down, each followed by a comma: a host's key starts with its parents' keys."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(","))


def _labels(key: Column, n: Column) -> Column:
    return F.concat(F.call_function("substring_index", key, F.lit(","), n), F.lit(","))


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """Judge every row of ``pages`` (page_id, url) by ``rules`` (action, host, path).

    A rule fits its host and all subdomains where the path starts with the rule's; the longest (host and path
    together, then the longer host, then the greater text) wins; without one the verdict is ``default``.
    Returns page_id, host, path, rule, verdict. Null urls and those without ``://`` have empty host and path and
    so no rule; repeated rows are judged alike; an empty table gives no rows; other columns are left out.

    A rule on a host is the interval of keys from ``com,example,`` up to ``com,example-``. Intervals nest or are
    apart, so the rules that hold from each bound on, its stack, are known from the bound alone. Pages and bounds
    are sorted together and each page takes the stack of the last bound before it. The sweep runs by the first
    two labels, which begin with the stack of the rules for the top level, and a pair of labels with many pages is
    swept in several groups, each with all of its bounds: no host, however frequent, ends in one task. Pages with equal page_id,
    host and path go to one group.
    """
    r = rules.select(F.coalesce(lower_ascii(F.col("host")), F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "action").filter("host <> ''").distinct()
    r = r.withColumn("key", host_key(F.col("host")))
    stacks = r.groupBy("key").agg(F.collect_set(F.struct("host", "path", "action")).alias("own"))
    # each rule key with the rules of all its parents, outermost first
    depth = F.size(F.split("key", ",")) - 1
    chain = stacks.select("key", F.explode(F.sequence(F.lit(1), depth)).alias("n")).withColumn("parent", _labels(F.col("key"), F.col("n")))
    chain = chain.join(stacks.select(F.col("key").alias("parent"), "own"), "parent").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("n", "own"))).alias("levels"))
    flat = lambda levels: F.flatten(F.transform(levels, lambda x: x["own"]))
    chain = chain.withColumn("active", flat(F.col("levels"))).withColumn("outer", flat(F.filter("levels", lambda x: _labels(F.col("key"), x["n"]) != F.col("key"))))
    top = F.size(F.split("key", ",")) == 2
    begins = chain.filter(~top).select(_labels(F.col("key"), F.lit(2)).alias("two"), F.col("key").alias("at"), F.lit(1).alias("kind"), F.col("active").alias("stack"))
    ends = chain.filter(~top).select(_labels(F.col("key"), F.lit(2)).alias("two"), F.concat(F.expr("substr(key, 1, length(key) - 1)"), F.lit("-")).alias("at"), F.lit(0).alias("kind"), F.col("outer").alias("stack"))
    bounds = begins.unionByName(ends)

    p = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path")).withColumn("at", host_key(F.col("host")))
    p = p.withColumn("two", _labels(F.col("at"), F.lit(2)))
    sizes = p.groupBy("two").agg(F.count(F.lit(1)).alias("rows")).join(bounds.groupBy("two").agg(F.count(F.lit(1)).alias("bounds")), "two", "left")
    sizes = sizes.select("two", F.ceil(F.col("rows") / F.greatest(F.lit(GROUP_ROWS), 4 * F.coalesce("bounds", F.lit(0)))).cast("int").alias("groups"))
    # only pairs of labels with several groups need to be joined to their pages, each in parts
    hot = sizes.filter("groups > 1").select("two", "groups", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"))
    first = sizes.withColumn("key", F.concat(F.substring_index("two", ",", 1), F.lit(","))).join(chain.filter(top).select("key", "active"), "key", "left")
    first = first.select("two", F.col("two").alias("at"), F.lit(-1).alias("kind"), F.coalesce("active", F.array().cast(f"array<{RULE}>")).alias("stack"))
    # the opening stack sorts before every key of its pair of labels
    opening = first.withColumn("at", F.lit(""))
    swept = opening.unionByName(bounds).join(sizes, "two").withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
    swept = swept.select("two", "group", "at", "kind", "stack", F.lit(None).cast(pages.schema["page_id"].dataType).alias("page_id"), F.lit("").alias("host"), F.lit("").alias("path"))
    spread = F.xxhash64("page_id", "path", "host")
    dealt = p.withColumn("part", F.pmod(F.shiftrightunsigned(spread, 32), F.lit(PARTS)).cast("int")).join(hot, ["two", "part"], "left")
    dealt = dealt.select("two", F.pmod(spread, F.coalesce("groups", F.lit(1))).cast("int").alias("group"), "at", F.lit(2).alias("kind"), F.lit(None).cast(f"array<{RULE}>").alias("stack"), "page_id", "host", "path")
    last = F.last("stack", ignorenulls=True).over(Window.partitionBy("two", "group").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0))
    # dealt out by both keys: by the pair of labels alone all of its groups would meet again
    found = swept.unionByName(dealt).repartition("two", "group").withColumn("active", last).filter("kind = 2")
    fits = F.filter("active", lambda x: F.startswith(F.col("path"), x["path"]))
    best = F.array_max(F.transform(fits, lambda x: F.struct((F.length(x["host"]) + F.length(x["path"])).alias("n"), F.length(x["host"]).alias("h"), F.concat(x["host"], x["path"]).alias("rule"), x["action"].alias("action"))))
    return found.withColumn("best", best).select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"))
