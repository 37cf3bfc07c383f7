import random

import pytest

import brute
from catchment.operators import coverage

AREA, SITE = "geoid string, lat double, lon double, population bigint", "site_id string, lat double, lon double"
CITY = (38.4, 38.9, -90.74, -90.12)


def world(seed, n_areas, n_sites, box=CITY, dense=0):
    rng = random.Random(seed)
    south, north, west, east = box
    areas = [(f"a{i:04d}", rng.uniform(south, north), rng.uniform(west, east), rng.randrange(0, 500)) for i in range(n_areas)]
    areas += [(f"d{i:04d}", rng.uniform(38.62, 38.64), rng.uniform(-90.22, -90.20), rng.randrange(0, 500)) for i in range(dense)]
    sites = [(f"s{i:03d}", rng.uniform(south, north), rng.uniform(west, east)) for i in range(n_sites)]
    return areas, sites


def frames(spark, areas, sites, parts=4):
    return (
        spark.createDataFrame(areas, AREA).repartition(parts),
        spark.createDataFrame(sites, SITE).repartition(parts),
    )


def picks(selection):
    return [(r.site_id, r.gain) for r in selection.sites.orderBy("rank").collect()]


@pytest.mark.parametrize("seed, radius, k", [(1, 1.0, 5), (2, 3.0, 12), (3, 8.0, 6), (4, 0.25, 4)])
def test_equals_plain_greedy(spark, seed, radius, k):
    areas, sites = world(seed, 300, 60)
    selection = coverage.greedy_cover(*frames(spark, areas, sites), radius, k)
    expected, covered = brute.greedy(areas, sites, radius, k)
    assert picks(selection) == expected
    gains = [g for _, g in expected]
    assert gains == sorted(gains, reverse=True)
    flagged = coverage.flag_covered(frames(spark, areas, sites)[0], selection).where("covered").collect()
    assert sorted(r.geoid for r in flagged) == sorted(areas[i][0] for i in covered)
    rows = selection.sites.orderBy("rank").collect()
    assert [r.cumulative_population for r in rows] == [sum(gains[: i + 1]) for i in range(len(gains))]


@pytest.mark.parametrize("leaf_points", [200, 40, 4, 1])
def test_refined_cells_give_the_same_picks(spark, leaf_points):
    areas, sites = world(11, 150, 40, dense=300)
    selection = coverage.greedy_cover(*frames(spark, areas, sites), 3.0, 5, options=coverage.SearchOptions(leaf_points=leaf_points))
    assert picks(selection) == brute.greedy(areas, sites, 3.0, 5)[0]


def test_split_hot_blocks_give_the_same_picks(spark):
    areas, sites = world(12, 200, 150, dense=100)
    expected = brute.greedy(areas, sites, 4.0, 4)[0]
    for leaf_points in (2048, 20):
        options = coverage.SearchOptions(leaf_points, most_pairs=500)
        assert picks(coverage.greedy_cover(*frames(spark, areas, sites), 4.0, 4, options=options)) == expected


def test_many_rounds_fold_into_a_checkpoint(spark):
    areas, sites = world(13, 250, 80, box=(38.5, 38.7, -90.4, -90.1))
    k = 2 * coverage.CONSOLIDATE_ROUNDS + 4
    options = coverage.SearchOptions(frontier_sites=1)
    selection = coverage.greedy_cover(*frames(spark, areas, sites), 1.5, k, options=options)
    assert picks(selection) == brute.greedy(areas, sites, 1.5, k)[0]
    assert selection.updates > coverage.CONSOLIDATE_ROUNDS
    assert selection.checkpoints == (selection.updates - 1) // coverage.CONSOLIDATE_ROUNDS


@pytest.mark.parametrize("frontier, leaf_points, most_pairs", [(10, 2048, 10**8), (10, 30, 10**8), (10, 30, 300), (3, 2, 10**8)])
def test_small_frontiers_cells_and_parts_together(spark, monkeypatch, frontier, leaf_points, most_pairs):
    cuts, plain = [], coverage._next_picks
    monkeypatch.setattr(coverage, "_next_picks", lambda f, s, beyond, *more: cuts.append(beyond) or plain(f, s, beyond, *more))
    areas, sites = world(21, 600, 200, dense=600)
    options = coverage.SearchOptions(leaf_points, most_pairs, frontier)
    selection = coverage.greedy_cover(*frames(spark, areas, sites), 2.5, 14, options=options)
    assert picks(selection) == brute.greedy(areas, sites, 2.5, 14)[0]
    assert selection.rounds > 1 and any(beyond is not None and beyond.people > 0 for beyond in cuts)


def divided(spark, areas, sites, radius, leaf_points, most_pairs=10**8):
    from catchment.operators.grid import Grid
    from catchment.sources.cache import FrameCache

    a, s = frames(spark, areas, sites)
    grid = Grid(radius)
    with FrameCache() as cache:
        reach = coverage.site_reach_blocks(s, grid)
        points, shape = coverage._divided(cache, coverage.demand_points(a, grid), reach, leaf_points, most_pairs)
        return (points.collect() if shape.depth else []), shape


def test_only_crowded_cells_are_divided(spark):
    """One dense square mile is cut finely; the blocks around it stay whole."""
    areas, sites = world(31, 200, 30, dense=400)
    points, shape = divided(spark, areas, sites, 3.0, 20)
    assert shape.depth >= 2 and shape.split is None
    leaves = {}
    for p in points:
        leaves.setdefault((p.block, p.leaf, p.leaf_row, p.leaf_col), []).append(p)
    assert all(len(held) <= 20 for (_, leaf, *_), held in leaves.items() if leaf < 4)
    apart = [p for p in points if not (38.5 < p.d_lat < 38.75 and -90.35 < p.d_lon < -90.05)]
    assert len(apart) > 50 and {p.leaf for p in apart} == {0}
    assert divided(spark, areas, sites, 3.0, 2048)[1] == (0, None, False)


def test_pair_bound_follows_the_tree(spark):
    areas, sites = world(32, 20, 120, box=(38.62, 38.64, -90.22, -90.20), dense=300)
    assert divided(spark, areas, sites, 3.0, 10**6, 20_000)[1].split == 20_000  # 320 points meet 120 sites
    assert divided(spark, areas, sites, 3.0, 64, 20_000)[1].split is None  # no cell of more than 64 does
    heap = [(f"h{i}", 38.63 + i * 1e-10, -90.21, 1) for i in range(300)]
    assert divided(spark, heap, sites, 3.0, 64, 20_000)[1] == (4, 20_000, False)  # nor can cells part these
    got = coverage.greedy_cover(*frames(spark, heap + areas, sites), 3.0, 2, options=coverage.SearchOptions(64, 20_000))
    assert picks(got) == brute.greedy(heap + areas, sites, 3.0, 2)[0]


def test_bounds_spare_updates(spark):
    """Far apart sites lose nothing to each other, so scores are never brought up to date again."""
    areas, sites = world(33, 900, 500, box=(20.0, 50.0, -120.0, -70.0))
    options = coverage.SearchOptions(frontier_sites=6)
    got = coverage.greedy_cover(*frames(spark, areas, sites), 80.0, 20, options=options)
    assert picks(got) == brute.greedy(areas, sites, 80.0, 20)[0]
    assert got.updates < got.rounds


def test_more_sites_than_are_broadcast(spark, monkeypatch):
    monkeypatch.setattr(coverage, "MOST_SITES", 2)
    monkeypatch.setattr(coverage, "MOST_CELLS", 0)
    monkeypatch.setattr(coverage, "PAIRS_AT_ONCE", 3)
    areas, sites = world(34, 200, 40, dense=200)
    frame_areas, frame_sites = frames(spark, areas, sites)
    got = coverage.greedy_cover(frame_areas, frame_sites, 2.0, 9, options=coverage.SearchOptions(50, frontier_sites=4))
    expected, covered = brute.greedy(areas, sites, 2.0, 9)
    assert picks(got) == expected
    flagged = coverage.flag_covered(frame_areas, got).where("covered").collect()
    assert sorted(r.geoid for r in flagged) == sorted(areas[i][0] for i in covered)


def test_many_ties_need_few_rounds(spark):
    sites = [(f"s{i:04d}", 30.0 + i // 40 * 0.2, -120.0 + i % 40 * 0.4) for i in range(1000)]
    areas = [(f"a{i}", lat, lon, 7) for i, lat, lon in sites]
    selection = coverage.greedy_cover(*frames(spark, areas, sites), 1.0, 20)
    assert picks(selection) == [(f"s{i:04d}", 7) for i in range(20)]
    assert selection.rounds <= 3


def test_ties_across_the_frontier_follow_the_order(spark):
    rng = __import__("random").Random(5)
    spots = [(30.0 + i * 0.5, -100.0) for i in range(30)]
    names = [f"s{i:02d}" for i in range(30)]
    rng.shuffle(names)
    sites = [(n, *spot) for n, spot in zip(names, spots)]
    areas = [(f"a{i}", *spot, 5 + i % 2) for i, spot in enumerate(spots)] + [("b", spots[0][0] + 0.25, -100.0, 0)]
    for frontier in (1, 4, 16):
        got = coverage.greedy_cover(*frames(spark, areas, sites), 2.0, 25, options=coverage.SearchOptions(frontier_sites=frontier))
        assert picks(got) == brute.greedy(areas, sites, 2.0, 25)[0]


def test_remaining_gains(spark):
    areas, sites = world(22, 200, 40)
    sites += [("twin", sites[3][1], sites[3][2])]
    got = coverage.remaining_gains(*frames(spark, areas, sites), 3.0, 2).collect()
    covered = brute.greedy(areas, sites, 3.0, 2)[1]
    want = {s[0]: sum(a[3] for i, a in enumerate(areas) if i not in covered and brute.miles(s[1], s[2], a[1], a[2]) <= 3.0) for s in sites}
    assert {r.site_id: r.gain for r in got} == want


def test_amounts_beyond_64_bits():
    import decimal

    import pyarrow as pa

    kind = pa.decimal128(38, 6)
    small = pa.chunked_array([pa.array([decimal.Decimal("1.5"), decimal.Decimal("-2.000001")], kind)])
    assert coverage._amounts(small)[0].tolist() == [1_500_000, -2_000_001] and coverage._amounts(small)[1] == 10**6
    large = pa.chunked_array([pa.array([decimal.Decimal(10) ** 20, decimal.Decimal("0.1")], kind)])
    assert coverage._amounts(large)[0].tolist() == [10**26, 100_000]


def test_distant_sites_are_picked_together(spark):
    areas, sites = world(14, 200, 60, box=(30.0, 45.0, -120.0, -80.0))
    assert picks(coverage.greedy_cover(*frames(spark, areas, sites), 60.0, 25)) == brute.greedy(areas, sites, 60.0, 25)[0]


def test_meridian_and_pole(spark):
    rng = random.Random(3)
    areas = [(f"a{i}", rng.uniform(85, 90), rng.uniform(-180, 180), rng.randrange(1, 99)) for i in range(200)]
    sites = [(f"s{i:02d}", rng.uniform(85, 90), rng.choice([179.99, -179.99, rng.uniform(-180, 180)])) for i in range(30)]
    assert picks(coverage.greedy_cover(*frames(spark, areas, sites), 90.0, 6)) == brute.greedy(areas, sites, 90.0, 6)[0]


def test_partitioning_does_not_matter(spark):
    areas, sites = world(15, 200, 50)
    results = [picks(coverage.greedy_cover(*frames(spark, areas, sites, n), 3.0, 6)) for n in (1, 3, 9)]
    assert results[0] == results[1] == results[2]


def test_more_sites_never_cover_less(spark):
    areas, sites = world(16, 200, 50)
    few, many = (picks(coverage.greedy_cover(*frames(spark, areas, sites), 2.0, k)) for k in (3, 6))
    assert many[:3] == few and sum(g for _, g in many) >= sum(g for _, g in few)


def test_larger_radius_never_lowers_the_first_gain(spark):
    areas, sites = world(17, 200, 50)
    first = [picks(coverage.greedy_cover(*frames(spark, areas, sites), r, 1))[0][1] for r in (1.0, 2.0, 4.0)]
    assert first == sorted(first)


def test_ties_go_to_the_first_site(spark):
    areas = [("a", 38.6, -90.2, 10), ("b", 38.6, -91.2, 10)]
    sites = [("s2", 38.6, -90.2), ("s1", 38.6, -91.2), ("s0", 38.6, -92.2), ("s3", 38.6, -91.2)]
    assert picks(coverage.greedy_cover(*frames(spark, areas, sites), 1.0, 5)) == [("s1", 10), ("s2", 10)]


def test_given_order_decides_ties(spark):
    areas = [("a", 38.6, -90.2, 10), ("b", 38.6, -91.2, 10)]
    sites = spark.createDataFrame([("s1", 38.6, -91.2, 2), ("s2", 38.6, -90.2, 1)], SITE + ", ordinal int")
    got = coverage.greedy_cover(spark.createDataFrame(areas, AREA), sites, 1.0, 1, order_by="ordinal")
    assert picks(got) == [("s2", 10)]


def test_repeated_geoid_counts_rows_for_gain_and_keys_for_coverage(spark):
    areas = [("a", 38.6, -90.2, 10), ("a", 40.0, -90.2, 7), ("b", 41.0, -90.2, 5)]
    demand, sites = frames(spark, areas, [("s", 38.6, -90.2)])
    selection = coverage.greedy_cover(demand, sites, 1.0, 3)
    assert picks(selection) == [("s", 10)]
    summary = coverage.coverage_summary(demand, selection).first()
    assert (summary.total_population, summary.covered_population) == (22, 17)
    assert coverage.covered_areas(demand, selection).count() == 2


def test_same_place_areas_and_unknown_population(spark):
    areas = [("a", 38.6, -90.2, 10)] * 4 + [("n", 38.6, -90.2, None), ("x", None, None, 3)]
    demand, sites = frames(spark, areas, [("s", 38.6, -90.2), ("t", None, None)])
    selection = coverage.greedy_cover(demand, sites, 1.0, 2)
    assert picks(selection) == [("s", 40)]
    assert coverage.coverage_summary(demand, selection).first().total_population == 43


def test_empty_cases(spark):
    areas, sites = world(18, 20, 5)
    frame_areas, frame_sites = frames(spark, areas, [(*s, "school") for s in sites][:0] or sites)
    typed = frame_sites.selectExpr("*", "'school' AS type", "site_id AS name")
    total = sum(a[3] for a in areas)
    every = [a[0] for a in areas]
    nobody = coverage.run_coverage(frame_areas, typed, ["nowhere"], 2.0, 3)
    assert nobody.summary.first().asDict() == {
        "total_population": 0, "covered_population": 0, "coverage_percent": 0.0, "selected_count": 0}
    closed = coverage.run_coverage(frame_areas, typed, every, 2.0, 3, site_types=["library"])
    assert closed.summary.first().total_population == total and closed.sites.count() == 0
    none = coverage.run_coverage(frame_areas, typed, every, 2.0, 0)
    assert none.sites.count() == 0 and none.summary.first().covered_population == 0
    with pytest.raises(ValueError):
        coverage.greedy_cover(frame_areas, typed, 2.0, -1)
    with pytest.raises(ValueError):
        coverage.greedy_cover(frame_areas, typed, -2.0, 1)
    with pytest.raises(ValueError):
        coverage.SearchOptions(frontier_sites=coverage.FRONTIER_SITES + 1)


def test_site_reach_counts_every_site(spark):
    areas, sites = world(19, 150, 30, dense=50)
    sites += [("twin", sites[0][1], sites[0][2]), ("far", 10.0, 10.0)]
    got = coverage.site_reach(*frames(spark, areas, sites), 3.0).collect()
    expected = {s[0]: sum(a[3] for a in areas if brute.miles(s[1], s[2], a[1], a[2]) <= 3.0) for s in sites}
    assert {r.site_id: r.reach_population for r in got} == expected


def test_fractional_population(spark):
    areas = spark.createDataFrame([("a", 38.6, -90.2, 0.1), ("b", 38.6, -90.2, 0.2)], AREA.replace("bigint", "double"))
    selection = coverage.greedy_cover(areas, spark.createDataFrame([("s", 38.6, -90.2)], SITE), 1.0, 1)
    assert [float(g) for _, g in picks(selection)] == [0.3]


def test_frames_are_released(spark):
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    areas, sites = world(20, 100, 30)
    coverage.greedy_cover(*frames(spark, areas, sites), 2.0, 12)
    assert spark.sparkContext._jsc.getPersistentRDDs().size() <= before
