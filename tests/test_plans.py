"""What the physical plans must and must not contain, with broadcasts by size switched off."""

import pytest

from catchment.operators.radius_join import radius_join
from catchment.operators.skew import key_parts, split_join
from catchment.plans import inputs
from catchment.plans.queries import QUERIES

NEVER = ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "MapInPandas", "MapInArrow")


@pytest.fixture
def no_size_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith(("src5", "snk", "cache"))))
def test_no_nested_loops_and_no_python(spark, sf_dir, no_size_broadcast, name):
    text = plan(QUERIES[name](spark, sf_dir))
    assert not [word for word in NEVER if word in text]


def test_radius_join_reads_two_columns_and_joins_on_the_block(spark, sf_dir, no_size_broadcast):
    text = plan(radius_join(inputs.areas(spark, sf_dir), inputs.sites(spark, sf_dir), 2.0))
    assert "ReadSchema: struct<c_custkey:bigint,c_acctbal:double>" in text
    assert "c_name" not in text and "geom_geojson" not in text
    assert "SortMergeJoin [block" in text or "ShuffledHashJoin [block" in text


def test_filters_reach_the_scan(spark, sf_dir):
    from catchment.sources.tables import read_table

    text = plan(read_table(spark, f"{sf_dir}/customer.parquet").where("c_nationkey = 3").select("c_custkey"))
    assert "PushedFilters: [IsNotNull(c_nationkey), EqualTo(c_nationkey,3)]" in text
    assert "ReadSchema: struct<c_custkey:bigint,c_nationkey:int>" in text


@pytest.mark.parametrize("most_pairs", [10, 300, 10_000])
def test_split_join_equals_a_plain_join_in_bounded_parts(spark, no_size_broadcast, most_pairs):
    from collections import Counter

    from pyspark.sql import functions as F

    left = spark.range(300).selectExpr("if(id % 3 = 0, 0, id % 20) AS k", "id AS a")
    right = spark.range(200).selectExpr("if(id % 3 = 0, 0, id % 25) AS k", "id AS b")
    parts = key_parts(left, right, ["k"], most_pairs)
    got = split_join(left, right, ["k"], ["a"], ["b"], parts).select("k", "a", "b").collect()
    want = left.join(right, "k").select("k", "a", "b")
    assert sorted(map(tuple, got)) == sorted(map(tuple, want.collect()))
    sides = [Counter(r.k for r in df.collect()) for df in (left, right)]
    dealt = {r.k: (r["_left_parts"], r["_right_parts"]) for r in parts.collect()}
    assert set(dealt) == {k for k in sides[0] if sides[0][k] * sides[1][k] > most_pairs}
    for k, (a, b) in dealt.items():
        assert (sides[0][k] / a) * (sides[1][k] / b) <= most_pairs
    assert "_left_part" not in split_join(left, right, ["k"], ["a"], ["b"], parts).columns and F


def test_both_sides_are_counted_in_one_aggregation(spark, no_size_broadcast):
    text = plan(key_parts(spark.range(9).selectExpr("id % 2 AS k"), spark.range(9).selectExpr("id % 3 AS k"), ["k"], 2))
    assert text.count("Exchange") == 1 and "Join" not in text
