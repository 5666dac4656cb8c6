from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from shirabe.operators import join
from shirabe.operators.window import latest_per_key

NESTED = ("BroadcastNestedLoopJoin", "CartesianProduct")


def no_nested_loop(text):
    assert not any(n in text for n in NESTED), text


def test_any_slot_matches_once_per_pair(spark, rows, plan):
    a = spark.createDataFrame([("1",), ("2",), (None,)], "k string")
    b = spark.createDataFrame([(1, "1", "1", None), (2, "2", "1", "3"), (3, None, None, None)], "id int, s1 string, s2 string, s3 string")
    out = join.join_any_slot(a, b, "k", ["s1", "s2", "s3"])
    assert rows(out, "k", "id") == [("1", 1), ("1", 2), ("2", 2)]
    no_nested_loop(plan(out))


def test_any_key_equals_or_join(spark, rows, plan):
    a = spark.range(60).select(F.nullif(F.col("id") % 7, F.lit(3)).alias("x1"), F.nullif(F.col("id") % 5, F.lit(2)).alias("x2"), F.col("id").alias("a"))
    b = spark.range(60).select(F.nullif(F.col("id") % 6, F.lit(1)).alias("y1"), F.nullif(F.col("id") % 4, F.lit(2)).alias("y2"), F.col("id").alias("b"))
    out = join.join_any_key(a, b, [("x1", "y1"), ("x2", "y2")])
    plain = a.join(b, (a.x1 == b.y1) | (a.x2 == b.y2))
    assert rows(out, "a", "b") == rows(plain, "a", "b")
    no_nested_loop(plan(out))


def test_only_one_in_group_equals_correlated_count(spark, rows, plan):
    people = spark.range(400).select(
        F.col("id").alias("sa_id"),
        (F.col("id") % 90).alias("block"),
        F.nullif(F.col("id") % 11, F.lit(4)).alias("p1"),
        F.nullif(F.col("id") % 13, F.lit(5)).alias("p2"),
    ).unionByName(spark.createDataFrame([(900, 5, None, None), (None, 6, 77, 77), (901, None, 1, 1)], "sa_id bigint, block bigint, p1 bigint, p2 bigint"))
    people.createOrReplaceTempView("people")
    out = join.only_one_in_group(people, people, "block", ["p1", "p2"], "sa_id")
    plain = spark.sql(
        """SELECT c.* FROM people c JOIN people t ON t.block = c.block AND (t.p1 = c.p1 OR t.p2 = c.p2)
           GROUP BY ALL HAVING count(DISTINCT t.sa_id) = 1"""
    )
    assert rows(out) == rows(plain)
    assert out.count() > 0
    no_nested_loop(plan(out))


def test_only_one_in_group_forms_no_pairs(spark):
    """Ten thousand rows in one block: a pair join would make a hundred million rows."""
    block = spark.range(10_000).select(F.col("id").alias("sa_id"), F.lit(1).alias("block"), F.lit(2).alias("p1"))
    assert join.only_one_in_group(block, block, "block", ["p1"], "sa_id").count() == 0


def test_cast_join_ignores_bad_keys(spark, rows):
    a = spark.createDataFrame([("1",), ("x",)], "k string")
    b = spark.createDataFrame([(1, "one"), (2, "two")], "n int, v string")
    assert rows(join.join_cast(a, b, "k", "n"), "k", "v") == [("1", "one")]


def test_exclude_multi_keeps_null_and_single(spark, rows):
    a = spark.createDataFrame([("p",), ("q",), (None,)], "k string")
    b = spark.createDataFrame([("p", 1), ("p", 2), ("q", 1), ("q", 1)], "k string, c int")
    assert rows(join.exclude_multi(a, b, "k", "c")) == [(None,), ("q",)]


def test_detect_delta(spark, rows):
    src = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, hash string")
    tgt = spark.createDataFrame([(1, "a"), (2, "x")], "id int, hash string")
    assert rows(join.detect_delta(src, tgt, "id", "hash")) == [
        (1, "a", False, False), (2, "b", False, True), (3, "c", True, False)
    ]


def test_row_hash_with_separators_in_the_data(spark):
    df = spark.createDataFrame([("x|1=y", "z"), ("x", "y|1=z"), ("x|=y", "z"), ("x", "y|=z")], "a string, b string")
    assert df.select(join.row_hash(["a", "b"])).distinct().count() == 4


def test_row_hash_tells_null_from_empty(spark):
    df = spark.createDataFrame([(None, ""), ("", None), ("", "")], "a string, b string")
    assert df.select(join.row_hash(["a", "b"])).distinct().count() == 3


def test_latest_per_key_total_order(spark, rows):
    df = spark.createDataFrame(
        [("k", 5, "b", None), ("k", 5, "a", 1), ("k", 4, "z", 2), (None, 1, "n", 3)], "k string, t int, v string, w int"
    )
    assert rows(latest_per_key(df, ["k"], ["t"])) == [(None, 1, "n", 3), ("k", 5, "a", 1)]


def test_reconcile_repeated_keys_stay_one_row(spark, rows):
    a = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    b = spark.createDataFrame([(1,), (3,)], "k int")
    assert rows(join.reconcile(a, b, "k")) == [
        (1, 2, 1, "OK"), (2, 1, None, "MISSING_IN_B"), (3, None, 1, "MISSING_IN_A")
    ]


@pytest.mark.parametrize("times", [1, 4])
def test_multiply_rows(spark, times):
    assert join.multiply_rows(spark.range(3), times, "n").count() == 3 * times
