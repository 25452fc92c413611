"""Tables between jobs, names, buckets."""

import collections

import pytest

from textloom.llm import common


def standing():
    return set(common._STANDING)


def test_tables_go_with_their_block(spark):
    before = standing()
    with common.scratch():
        made = common.stored(spark.range(5))
        assert made.count() == 5 and len(standing() - before) == 1
    assert standing() == before
    with common.scratch(keep=1):
        common.stored(spark.range(3))
        last = common.stored(spark.range(7))
    assert len(standing() - before) == 1 and last.count() == 7
    with pytest.raises(KeyError):
        with common.scratch(keep=1):
            common.stored(spark.range(3))
            raise KeyError
    assert len(standing() - before) == 1
    common.drop_stored(frozenset(before))
    assert standing() == before


def test_names_that_no_column_has(spark):
    df = spark.range(1).selectExpr("id AS Row", "id AS row_")
    assert common.fresh(df, "row") == "row__" and common.fresh(df, "other") == "other"


def test_keys_of_the_same_nodes_meet_once(spark):
    members = {1: "ab", 2: "ab", 3: "abc", 4: "c", 5: "ba", 6: "cd", 7: "abd"}
    df = spark.createDataFrame([(k, n) for k, ns in members.items() for n in ns], "key long, node string")
    got = collections.defaultdict(set)
    for r in common.different_buckets(df, "key", "node").collect():
        got[r["key"]].add(r["node"])
    assert dict(got) == {1: set("ab"), 3: set("abc"), 6: set("cd"), 7: set("abd")}
