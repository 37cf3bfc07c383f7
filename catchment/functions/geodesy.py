"""Distances on the sphere and the UTM projection.

Expressions on the hot path are built as SQL text, which Spark parses in one go.

Two forms of the radius test live here.  ``haversine_sql`` is the defining one.
``within_sql`` gives the same answer for pairs that carry unit vectors:
straight-line (chord) distance decides all pairs that are not within a hair of
the rim, so the trigonometry runs only for the few that are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_MILES = 3958.7613

# GRS80 ellipsoid and UTM constants (fixed values).
GRS80_A = 6378137.0
GRS80_F = 1 / 298.257222101
UTM_SCALE = 0.9996
UTM_FALSE_EASTING = 500000.0


def sql_number(value: float) -> str:
    """A double literal; a bare SQL number would be a decimal."""
    return f"{float(value)!r}D"


def haversine_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    """Great-circle distance in miles; the clamp keeps antipodal pairs from becoming NaN."""
    half_lat, half_lon = f"sin(radians({lat2} - {lat1}) / 2)", f"sin(radians({lon2} - {lon1}) / 2)"
    a = f"{half_lat} * {half_lat} + cos(radians({lat1})) * cos(radians({lat2})) * ({half_lon} * {half_lon})"
    return f"{sql_number(2 * EARTH_RADIUS_MILES)} * asin(sqrt(least(1.0D, {a})))"


def haversine_miles(lat1: str, lon1: str, lat2: str, lon2: str) -> Column:
    return F.expr(haversine_sql(lat1, lon1, lat2, lon2))


def central_angle(radius_miles: float) -> float:
    """Angle in radians that a surface distance spans, at most half a turn."""
    return min(radius_miles / EARTH_RADIUS_MILES, math.pi)


def usable_point(lat: str, lon: str) -> Column:
    return F.expr(f"{lat} IS NOT NULL AND {lon} IS NOT NULL AND NOT isnan({lat}) AND NOT isnan({lon})")


def unit_vector_sql(lat: str, lon: str) -> list[str]:
    """``x, y, z`` of the point on the unit sphere."""
    return [
        f"cos(radians({lat})) * cos(radians({lon}))",
        f"cos(radians({lat})) * sin(radians({lon}))",
        f"sin(radians({lat}))",
    ]


def unit_vector(lat: float, lon: float) -> tuple[float, float, float]:
    phi, lam = math.radians(lat), math.radians(lon)
    return math.cos(phi) * math.cos(lam), math.cos(phi) * math.sin(lam), math.sin(phi)


def chord_limits(radius_miles: float) -> tuple[float, float]:
    """Squared chords that are surely inside and possibly inside the radius.

    The gap is far wider than the rounding error of a chord of that length and
    far narrower than any distance between real places.
    """
    chord = 2 * math.sin(central_angle(radius_miles) / 2)
    slack = chord * chord * 1e-9 + chord * 1e-14 + 1e-28
    return chord * chord - slack, chord * chord + slack


def squared_chord_sql(a: list[str], b: list[str]) -> str:
    return " + ".join(f"({p} - {q}) * ({p} - {q})" for p, q in zip(a, b))


def within_sql(point: tuple[list[str], str, str], other: tuple[list[str], str, str], radius_miles: float) -> str:
    """``haversine <= radius`` for two sides given as (unit vector, lat, lon)."""
    sure, maybe = chord_limits(radius_miles)
    chord2 = squared_chord_sql(point[0], other[0])
    exact = haversine_sql(point[1], point[2], other[1], other[2])
    return (
        f"({chord2} <= {sql_number(sure)} OR "
        f"({chord2} <= {sql_number(maybe)} AND {exact} <= {sql_number(radius_miles)}))"
    )


def side(prefix: str) -> tuple[list[str], str, str]:
    """Column names of one side of a pair: unit vector, latitude, longitude."""
    return [prefix + axis for axis in "xyz"], prefix + "lat", prefix + "lon"


_E2 = GRS80_F * (2 - GRS80_F)
_EP2 = _E2 / (1 - _E2)
# Meridian arc per radian and its Fourier terms (Snyder 1987, eq. 3-21).
_ARC = 1 - _E2 / 4 - 3 * _E2**2 / 64 - 5 * _E2**3 / 256
_ARC_TERMS = [
    (-(3 * _E2 / 8 + 3 * _E2**2 / 32 + 45 * _E2**3 / 1024), 2),
    (15 * _E2**2 / 256 + 45 * _E2**3 / 1024, 4),
    (-(35 * _E2**3 / 3072), 6),
]
# Footpoint latitude from the rectifying latitude (Snyder 1987, eq. 3-26).
_E1 = (1 - math.sqrt(1 - _E2)) / (1 + math.sqrt(1 - _E2))
_FOOT_TERMS = [
    (3 * _E1 / 2 - 27 * _E1**3 / 32, 2),
    (21 * _E1**2 / 16 - 55 * _E1**4 / 32, 4),
    (151 * _E1**3 / 96, 6),
    (1097 * _E1**4 / 512, 8),
]




def utm_central_meridian(zone: int) -> float:
    return zone * 6.0 - 183.0


def _sine_series(terms: list[tuple[float, int]], angle: str) -> str:
    return " + ".join(f"{sql_number(weight)} * sin({multiple} * {angle})" for weight, multiple in terms)


def _stages(values: str, *stages: str) -> str:
    """Maps an array through several steps, so that each step's terms are computed once."""
    for stage in stages:
        values = f"transform({values}, v -> {stage})"
    return values


def utm_forward_sql(points: str, zone: int = 15) -> str:
    """Array of ``[lon, lat]`` to array of ``[easting, northing]`` in metres.

    Northern hemisphere, Snyder 1987 equations 8-9 to 8-15.
    """
    n = sql_number
    return _stages(
        points,
        f"named_struct('phi', radians(get(v, 1)), 'lam', radians(get(v, 0) - {n(utm_central_meridian(zone))}))",
        "named_struct('phi', v.phi, 'lam', v.lam, 'sin', sin(v.phi), 'cos', cos(v.phi), 'tan', tan(v.phi))",
        f"named_struct('a', v.lam * v.cos, 't', v.tan * v.tan, 'c', {n(_EP2)} * v.cos * v.cos, 'tan', v.tan, "
        f"'n', {n(GRS80_A)} / sqrt(1 - {n(_E2)} * v.sin * v.sin), "
        f"'arc', {n(GRS80_A)} * ({n(_ARC)} * v.phi + {_sine_series(_ARC_TERMS, 'v.phi')}))",
        "named_struct('n', v.n, 'tan', v.tan, 'arc', v.arc, 'a', v.a, 'a2', v.a * v.a, "
        "'e3', 1 - v.t + v.c, "
        f"'e5', 5 - 18 * v.t + v.t * v.t + 72 * v.c - {n(58 * _EP2)}, "
        "'n4', 5 - v.t + 9 * v.c + 4 * v.c * v.c, "
        f"'n6', 61 - 58 * v.t + v.t * v.t + 600 * v.c - {n(330 * _EP2)})",
        f"array({n(UTM_FALSE_EASTING)} + {n(UTM_SCALE)} * v.n * v.a * (1 + v.a2 * (v.e3 / 6 + v.a2 * v.e5 / 120)), "
        f"{n(UTM_SCALE)} * (v.arc + v.n * v.tan * v.a2 * (0.5D + v.a2 * (v.n4 / 24 + v.a2 * v.n6 / 720))))",
    )


def utm_inverse_sql(easting: str, northing: str, zone: int = 15) -> str:
    """Struct ``lat, lon`` in degrees; northern hemisphere, Snyder 1987 equations 8-17 to 8-25."""
    n = sql_number
    staged = _stages(
        f"array(named_struct('e', {easting} - {n(UTM_FALSE_EASTING)}, "
        f"'mu', {northing} / {n(UTM_SCALE * GRS80_A * _ARC)}))",
        f"named_struct('e', v.e, 'foot', v.mu + {_sine_series(_FOOT_TERMS, 'v.mu')})",
        "named_struct('e', v.e, 'foot', v.foot, 'cos', cos(v.foot), 'tan', tan(v.foot), "
        f"'w', 1 - {n(_E2)} * sin(v.foot) * sin(v.foot))",
        "named_struct('foot', v.foot, 'cos', v.cos, 'tan', v.tan, 'w', v.w, "
        f"'c', {n(_EP2)} * v.cos * v.cos, 't', v.tan * v.tan, "
        f"'d', v.e * sqrt(v.w) / {n(GRS80_A * UTM_SCALE)})",
        "named_struct('foot', v.foot, 'cos', v.cos, 'd', v.d, 'd2', v.d * v.d, "
        f"'slope', v.tan * v.w / {n(1 - _E2)}, "
        f"'p4', 5 + 3 * v.t + 10 * v.c - 4 * v.c * v.c - {n(9 * _EP2)}, "
        f"'p6', 61 + 90 * v.t + 298 * v.c + 45 * v.t * v.t - {n(252 * _EP2)} - 3 * v.c * v.c, "
        "'l3', 1 + 2 * v.t + v.c, "
        f"'l5', 5 - 2 * v.c + 28 * v.t - 3 * v.c * v.c + {n(8 * _EP2)} + 24 * v.t * v.t)",
        "named_struct('lat', degrees(v.foot - v.slope * v.d2 * (0.5D - v.d2 * (v.p4 / 24 - v.d2 * v.p6 / 720))), "
        "'lon', degrees(v.d * (1 - v.d2 * (v.l3 / 6 - v.d2 * v.l5 / 120)) / v.cos) "
        f"+ {n(utm_central_meridian(zone))})",
    )
    return f"get({staged}, 0)"
