import json
import math

import pytest

from catchment.functions import geometry
from catchment.functions.geodesy import utm_forward_sql, utm_inverse_sql

HOLED = {"type": "Polygon", "coordinates": [
    [[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]],
    [[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]],
]}
TWO_PARTS = {"type": "MultiPolygon", "coordinates": [
    [[[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]]],
    [[[10, 0], [10, 1], [11, 1], [11, 0], [10, 0]]],
]}


def parsed(spark, *geometries):
    rows = [(str(i), g if isinstance(g, str) or g is None else json.dumps(g)) for i, g in enumerate(geometries)]
    return geometry.with_parts(spark.createDataFrame(rows, "geoid string, g string"), "g").orderBy("geoid")


def centroids(df):
    return [(r.lon, r.lat) for r in geometry.with_centroid(df, "parts").orderBy("geoid").collect()]


def test_holes_and_parts_are_weighed_by_area(spark):
    holed, two = centroids(parsed(spark, HOLED, TWO_PARTS))
    # 16 at (2, 2) less 4 at (1, 1); 4 at (1, 1) and 1 at (10.5, 0.5).
    assert holed == pytest.approx(((32 - 4) / 12, (32 - 4) / 12))
    assert two == pytest.approx(((4 + 10.5) / 5, (4 + 0.5) / 5))


def test_direction_and_closing_of_rings_do_not_matter(spark):
    backwards = {"type": "Polygon", "coordinates": [r[::-1] for r in HOLED["coordinates"]]}
    open_rings = {"type": "Polygon", "coordinates": [r[:-1] for r in HOLED["coordinates"]]}
    for got in centroids(parsed(spark, backwards, open_rings)):
        assert got == pytest.approx((28 / 12, 28 / 12))


def test_unusable_geometry_is_null(spark):
    bad = [None, "not json", "{}", {"type": "Point", "coordinates": [1, 2]}, {"type": "Polygon"},
           {"type": "Polygon", "coordinates": []}, {"type": "Polygon", "coordinates": [[[1, 1], [2, 2], [1, 1]]]}]
    df = parsed(spark, *bad)
    assert centroids(df) == [(None, None)] * len(bad)
    assert [r.parts for r in df.collect()][:5] == [None] * 5


def test_small_far_shape_keeps_its_precision(spark):
    x, y, d = -90.2345678, 38.7654321, 1e-6
    tiny = {"type": "Polygon", "coordinates": [[[x, y], [x + d, y], [x + d, y + d], [x, y + d], [x, y]]]}
    (lon, lat), = centroids(parsed(spark, tiny))
    assert (lon, lat) == pytest.approx((x + d / 2, y + d / 2), abs=1e-12)


def test_rings_and_parts(spark):
    df = parsed(spark, HOLED, TWO_PARTS)
    first = [r.ring for r in df.withColumn("ring", geometry.first_outer_ring("parts")).collect()]
    assert first == [HOLED["coordinates"][0], TWO_PARTS["coordinates"][0][0]]
    parts = geometry.explode_parts(df, "parts", ["geoid"]).collect()
    assert sorted((r.geoid, r.polygon[0]) for r in parts) == [("0", [0, 0]), ("1", [0, 0]), ("1", [10, 0])]


def test_text_round_trip(spark):
    df = parsed(spark, HOLED, TWO_PARTS).withColumn("text", geometry.to_geojson("parts"))
    assert [json.loads(r.text) for r in df.collect()] == [HOLED, TWO_PARTS]


def kruger_forward(lat, lon, zone=15):
    """Kruger series in the third flattening, a different expansion than the one tested."""
    a, f = 6378137.0, 1 / 298.257222101
    n = f / (2 - f)
    big_a = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    phi, lam = math.radians(lat), math.radians(lon - (zone * 6 - 183))
    e = 2 * math.sqrt(n) / (1 + n)
    t = math.sinh(math.atanh(math.sin(phi)) - e * math.atanh(e * math.sin(phi)))
    xi, eta = math.atan2(t, math.cos(lam)), math.atanh(math.sin(lam) / math.sqrt(1 + t * t))
    east = eta + sum(c * math.cos(2 * j * xi) * math.sinh(2 * j * eta) for j, c in enumerate(alpha, 1))
    north = xi + sum(c * math.sin(2 * j * xi) * math.cosh(2 * j * eta) for j, c in enumerate(alpha, 1))
    return 500000 + 0.9996 * big_a * east, 0.9996 * big_a * north


def test_projection_agrees_with_another_series_and_turns_back(spark):
    points = [(38.4, -90.74), (38.9, -90.12), (38.63, -90.2), (38.0, -93.0), (45.0, -95.9), (5.0, -91.5)]
    df = spark.createDataFrame(points, "lat double, lon double")
    df = df.selectExpr("lat", "lon", f"get({utm_forward_sql('array(array(lon, lat))')}, 0) AS en")
    df = df.selectExpr("*", f"{utm_inverse_sql('en[0]', 'en[1]')} AS back")
    for r in df.collect():
        assert r.en == pytest.approx(kruger_forward(r.lat, r.lon), abs=2e-3)
        assert (r.back.lat, r.back.lon) == pytest.approx((r.lat, r.lon), abs=1e-8)


def test_projected_centroid_is_near_the_plain_one(spark):
    ring = [[-90.3, 38.5], [-90.1, 38.5], [-90.15, 38.7], [-90.3, 38.65], [-90.3, 38.5]]
    df = parsed(spark, {"type": "Polygon", "coordinates": [ring]})
    (lon, lat), = centroids(df)
    got = geometry.with_projected_centroid(df, "parts").first()
    metres = math.hypot((got.lat - lat) * 111_000, (got.lon - lon) * 87_000)
    assert 0 < metres < 30


def test_rings_of_many_vertices(spark):
    """Against the textbook sums, open and closed, with a hole."""
    from fractions import Fraction

    def moments(ring):
        c = x = y = Fraction(0)
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
            cross = ax * by - bx * ay
            c, x, y = c + cross, x + (ax + bx) * cross, y + (ay + by) * cross
        return c, x, y

    outer = [[round(-90 + math.cos(t / 100 * math.pi) * (1 + t % 7 / 10), 4), round(38 + math.sin(t / 100 * math.pi), 4)] for t in range(200)]
    hole = [[-90.1, 38.1], [-90.0, 38.1], [-90.0, 38.2]]
    total = [Fraction(0)] * 3
    for ring, sign in ((outer, 1), (hole, -1)):
        m = moments([[Fraction(str(v)) for v in p] for p in ring])
        total = [t + sign * (1 if m[0] > 0 else -1) * v for t, v in zip(total, m)]
    want = float(total[1] / (3 * total[0])), float(total[2] / (3 * total[0]))
    for rings in ([outer, hole], [outer + outer[:1], hole[::-1] + hole[-1:]]):
        text = json.dumps({"type": "Polygon", "coordinates": rings})
        df = geometry.with_parts(spark.createDataFrame([(text,)], "g string"), "g")
        row = geometry.with_centroid(df, "parts").first()
        assert (row.lon, row.lat) == pytest.approx(want, abs=1e-9)
