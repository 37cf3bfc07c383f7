import random

import pytest

import brute
from catchment.operators.radius_join import radius_join

AREA, SITE = "geoid string, lat double, lon double, population bigint", "site_id string, lat double, lon double"


def cloud(rng, n, box, prefix):
    south, north, west, east = box
    return [
        (f"{prefix}{i:04d}", rng.uniform(south, north), (rng.uniform(west, east) + 180) % 360 - 180) for i in range(n)
    ]


BOXES = {
    "city": (38.4, 38.9, -90.74, -90.12),
    "meridian": (-1.0, 1.0, 179.0, 181.0),
    "north_pole": (88.5, 90.0, -180.0, 180.0),
    "south_pole": (-90.0, -88.0, -180.0, 180.0),
    "equator": (-0.5, 0.5, -0.5, 0.5),
    "globe": (-90.0, 90.0, -180.0, 180.0),
}


@pytest.mark.parametrize("box, radius", [
    ("city", 0.25), ("city", 2.0), ("city", 10.0), ("meridian", 15.0), ("north_pole", 20.0), ("south_pole", 60.0),
    ("equator", 5.0), ("globe", 500.0), ("globe", 4000.0), ("globe", 7000.0), ("globe", 13000.0),
])
def test_equals_brute_force(spark, box, radius):
    rng = random.Random(f"{box}{radius}")
    sites = cloud(rng, 40, BOXES[box], "s")
    areas = [(*a, 1) for a in cloud(rng, 250, BOXES[box], "a")]
    got = radius_join(spark.createDataFrame(areas, AREA), spark.createDataFrame(sites, SITE), radius)
    rows = got.collect()
    assert sorted((r.site_id, r.geoid) for r in rows) == brute.pairs(areas, sites, radius)
    where = {s[0]: s for s in sites} | {a[0]: a for a in areas}
    for r in rows[:200]:
        s, a = where[r.site_id], where[r.geoid]
        assert r.distance_miles == pytest.approx(brute.miles(s[1], s[2], a[1], a[2]), abs=1e-6)


def test_hot_blocks_are_split_without_loss(spark):
    rng = random.Random(5)
    sites = cloud(rng, 20, BOXES["city"], "s")
    dense = (38.62, 38.63, -90.21, -90.20)
    areas = [(*a, 1) for a in cloud(rng, 300, dense, "h") + cloud(rng, 100, BOXES["city"], "a")]
    frames = spark.createDataFrame(areas, AREA), spark.createDataFrame(sites, SITE)
    for most_pairs in (40, 900):
        got = radius_join(*frames, 3.0, most_pairs=most_pairs).collect()
        assert sorted((r.site_id, r.geoid) for r in got) == brute.pairs(areas, sites, 3.0)


def test_repeated_rows_and_unusable_coordinates(spark):
    areas = [("a", 38.6, -90.2, 1)] * 3 + [("n", None, -90.2, 1), ("x", float("nan"), -90.2, 1)]
    sites = [("s", 38.6, -90.2), ("m", None, None)]
    got = radius_join(spark.createDataFrame(areas, AREA), spark.createDataFrame(sites, SITE), 1.0).collect()
    assert [(r.site_id, r.geoid, r.distance_miles) for r in got] == [("s", "a", 0.0)] * 3


def test_radius_zero_and_exact_rim(spark):
    areas = [("same", 38.6, -90.2, 1), ("near", 38.6, -90.2000001, 1), ("north", 39.6, -90.2, 1)]
    frames = spark.createDataFrame(areas, AREA), spark.createDataFrame([("s", 38.6, -90.2)], SITE)
    assert [r.geoid for r in radius_join(*frames, 0.0).collect()] == ["same"]
    rim = [r for r in radius_join(*frames, 100.0).collect() if r.geoid == "north"][0].distance_miles
    assert "north" in {r.geoid for r in radius_join(*frames, rim).collect()}
    assert "north" not in {r.geoid for r in radius_join(*frames, rim * (1 - 1e-12)).collect()}


def test_bad_arguments(spark):
    frames = spark.createDataFrame([("a", 1.0, 1.0, 1)], AREA), spark.createDataFrame([("s", 1.0, 1.0)], SITE)
    with pytest.raises(ValueError):
        radius_join(*frames, -1.0)
    with pytest.raises(ValueError):
        radius_join(*frames, 1.0, area_columns=["lat"], site_columns=["lat"])


def test_copies_are_classes(spark):
    """Equal rows in crowded blocks are counted, cut into classes, tested once and repeated."""
    from collections import Counter

    from catchment.operators import skew

    areas = [("heap", 38.6, -90.2, 7)] * 5000 + [("lone", 38.61, -90.2, 1), ("far", 10.0, 10.0, 1)]
    sites = [(f"s{i:03d}", 38.6 + i * 1e-5, -90.2) for i in range(60)] + [("s000", 38.6, -90.2)] * 40 + [("away", 10.0, 10.0)]
    frames = spark.createDataFrame(areas, AREA).repartition(3), spark.createDataFrame(sites, SITE)
    got = radius_join(*frames, 1.0, most_pairs=20_000).groupBy("site_id", "geoid").count().collect()
    copies = Counter(s[0] for s in sites)
    want = {(s, g): copies[s] * n for s in copies if s != "away" for g, n in (("heap", 5000), ("lone", 1))} | {("away", "far"): 1}
    assert {(r.site_id, r.geoid): r["count"] for r in got} == want
    rows = spark.createDataFrame([(1, "a")] * 2500 + [(1, "b"), (2, "c"), (2, "c")], "block int, v string")
    parts = spark.createDataFrame([(1,)], "block int")
    met = skew.classes(rows, parts, ["block"], "left", 1000)
    assert sorted((r.v, r._left_copies, r._left_class) for r in met.collect()) == [
        ("a", 500, 2), ("a", 1000, 0), ("a", 1000, 1), ("b", 1, 0), ("c", 1, 0), ("c", 1, 0)]


def test_nothing_is_cut_where_nothing_is_crowded(spark):
    frames = spark.createDataFrame([("a", 38.6, -90.2, 1)] * 9, AREA), spark.createDataFrame([("s", 38.6, -90.2)], SITE)
    plan = radius_join(*frames, 1.0)._jdf.queryExecution().optimizedPlan().toString()
    assert "_copies" not in plan and "_part" not in plan


def test_a_join_of_many_pairs_is_dealt_to_tasks(spark, monkeypatch):
    """Small tables with many pairs come out of several tasks, though one partition holds them."""
    from pyspark.sql import functions as F

    from catchment.operators import skew

    monkeypatch.setattr(skew, "TASK_PAIRS", 200)
    rng = random.Random(8)
    areas, sites = [(*a, 1) for a in cloud(rng, 400, BOXES["city"], "a")], cloud(rng, 100, BOXES["city"], "s")
    frames = spark.createDataFrame(areas, AREA).coalesce(1), spark.createDataFrame(sites, SITE).coalesce(1)
    rows = radius_join(*frames, 2.0).withColumn("task", F.spark_partition_id()).collect()
    assert sorted((r.site_id, r.geoid) for r in rows) == brute.pairs(areas, sites, 2.0)
    assert len({r.task for r in rows}) > 1


def test_parts_repeat_a_bounded_number_of_rows(spark):
    from catchment.operators import skew

    for n in (300, 3000):
        left, right = spark.range(n).selectExpr("1 AS k", "id AS a"), spark.range(n).selectExpr("1 AS k", "id AS b")
        cut = skew.key_parts(left, right, ["k"], 500, skew.MOST_REPEATS).first()
        assert 1 < cut["_left_parts"] and cut["_left_parts"] + cut["_right_parts"] <= 4 * skew.MOST_REPEATS
    few = spark.range(3).selectExpr("1 AS k", "id AS b")
    cut = skew.key_parts(left, few, ["k"], 500, skew.MOST_REPEATS).first()
    assert cut["_left_parts"] * 500 >= 3000 * 3 and cut["_right_parts"] == 1


def test_crowded_blocks_repeat_a_bounded_number_of_rows(spark):
    rng = random.Random(9)
    dense = (38.62, 38.63, -90.21, -90.20)
    areas, sites = [(*a, 1) for a in cloud(rng, 900, dense, "a")], cloud(rng, 300, dense, "s")
    met = radius_join(spark.createDataFrame(areas, AREA), spark.createDataFrame(sites, SITE), 0.3, most_pairs=20,
                      together=("geoid", "site_id"))
    rows = met.collect()
    assert sorted((r.site_id, r.geoid) for r in rows) == brute.pairs(areas, sites, 0.3)
    assert max(r["_left_part"] for r in rows) < 100 and max(r["_right_part"] for r in rows) < 100


@pytest.mark.parametrize("most_pairs", [50, 10**8])
def test_pairs_together_are_grouped_without_moving(spark, monkeypatch, most_pairs):
    """Ids that repeat, at one place, at several or without a name, are one group each, in one task."""
    from collections import Counter

    from pyspark.sql import functions as F

    from catchment.operators import skew
    from catchment.operators.radius_join import TOGETHER

    monkeypatch.setattr(skew, "TASK_PAIRS", 100)
    rng = random.Random(10)
    spots = cloud(rng, 150, BOXES["city"], "a")
    areas = [(*a, 1) for a in spots + spots[:20]] + [(f"a{rng.randrange(30):04d}", *a[1:], 2) for a in cloud(rng, 60, BOXES["city"], "x")]
    areas += [(None, *a[1:], 3) for a in cloud(rng, 40, BOXES["city"], "n")]
    sites = cloud(rng, 60, BOXES["city"], "s")
    sites += sites[:5] + [(f"s{i:04d}", *s[1:]) for i, s in enumerate(cloud(rng, 10, BOXES["city"], "t"))]
    frames = spark.createDataFrame(areas, AREA), spark.createDataFrame(sites, SITE)
    got = radius_join(*frames, 4.0, most_pairs=most_pairs, together=("geoid", "site_id"))
    counted = got.groupBy("site_id", "geoid", *TOGETHER).agg(F.count("*").alias("rows"))
    want = Counter((s[0], a[0]) for a in areas for s in sites if brute.miles(s[1], s[2], a[1], a[2]) <= 4.0)
    rows = counted.collect()
    assert len({(r.site_id, r.geoid) for r in rows}) == len(rows)
    assert {(r.site_id, r.geoid): r["rows"] for r in rows} == dict(want)
    text = counted._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert "Exchange" not in text[:text.index("SortMergeJoin")]


def exchanges(df):
    """Moves of rows in the plan, from the join down."""
    text = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    return [line for line in text.splitlines() if " Exchange " in line]


@pytest.mark.parametrize("most_pairs", [20, 10**8])
def test_rows_are_moved_once_and_without_what_follows(spark, monkeypatch, most_pairs):
    """Crowded keys are told from the others, and rows repeated for parts, without moving rows for it."""
    from catchment.operators import skew

    monkeypatch.setattr(skew, "TASK_PAIRS", 100)
    rng = random.Random(11)
    areas, sites = [(*a, 1) for a in cloud(rng, 500, BOXES["city"], "a")], cloud(rng, 120, BOXES["city"], "s")
    got = radius_join(spark.createDataFrame(areas, AREA), spark.createDataFrame(sites, SITE), 3.0, most_pairs=most_pairs)
    assert sorted((r.site_id, r.geoid) for r in got.collect()) == brute.pairs(areas, sites, 3.0)
    assert len(exchanges(got)) == 2
    text = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    below = text[text.index(" Exchange "):].splitlines()[1]
    assert "d_x" not in below and "d_x" in text
    assert most_pairs > 20 or text.index("_right_part") < text.index(" Exchange ")


def test_cells_of_parts(spark, monkeypatch):
    """Parts are dealt in cells, with copies merged or not, and each pair comes once."""
    from collections import Counter

    from catchment.operators import radius_join as r, skew

    monkeypatch.setattr(skew, "TASK_PAIRS", 150)
    monkeypatch.setattr(r, "MOST_PAIRS", 300)
    rng = random.Random(12)
    dense = (38.62, 38.64, -90.22, -90.20)
    for copies in (1, 5):
        areas, sites = [(*a, 1) for a in cloud(rng, 260, dense, "a")] * copies, cloud(rng, 90, dense, "s")
        got = radius_join(spark.createDataFrame(areas, AREA), spark.createDataFrame(sites, SITE), 0.5, most_pairs=30)
        want = Counter(brute.pairs(areas, sites, 0.5))
        assert Counter((x.site_id, x.geoid) for x in got.collect()) == want
        assert ("_left_copies" in got._jdf.queryExecution().optimizedPlan().toString()) == (copies > 1)


def test_cells_are_no_more_than_parts(spark):
    from catchment.operators import skew

    counted = spark.createDataFrame([(1, 3000, 2000), (2, 40, 30), (3, 100_000, 2)], "k int, _left bigint, _right bigint")
    parts = skew.with_cells(skew.cut_keys(counted, ["k"], 500, 4), counted, ["k"], 100_000, 4)
    rows = {r.k: (r._left_parts, r._right_parts, r._left_cells, r._right_cells) for r in parts.collect()}
    assert set(rows) == {1, 2, 3} and rows[2][2:] == (1, 1) and rows[1][2] > 1
    assert all(c <= p for r in rows.values() for p, c in zip(r[:2], r[2:]))
