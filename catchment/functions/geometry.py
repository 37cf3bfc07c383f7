"""GeoJSON polygons as nested arrays, row by row and without any shuffle.

``parts`` is the common form of Polygon and MultiPolygon: an array of parts, each
an array of rings (the outer one first), each an array of ``[lon, lat]``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catchment.functions.geodesy import utm_forward_sql, utm_inverse_sql

PART_TYPE = "array<array<array<double>>>"
PARTS_TYPE = f"array<{PART_TYPE}>"


def computed_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Adds costly columns behind a generator of one row.

    The optimizer copies the definition of an ordinary column into every filter on
    it, and so on down a chain of columns.  It does not do so across a generator.
    """
    row = F.struct(*[c.alias(name) for name, c in columns.items()])
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(row)))


def with_parts(df: DataFrame, geojson: str, out: str = "parts") -> DataFrame:
    """Adds the parts of a Polygon or MultiPolygon; null for any other kind and for bad text.

    The text is parsed once, into a VARIANT, and fields are taken from that.  A coordinate that is no number
    is null.
    """
    one_part = f"try_variant_get(_json, '$.coordinates', '{PART_TYPE}')"
    parts = (
        "CASE try_variant_get(_json, '$.type', 'string') "
        f"WHEN 'Polygon' THEN filter(array({one_part}), p -> p IS NOT NULL) "
        f"WHEN 'MultiPolygon' THEN try_variant_get(_json, '$.coordinates', '{PARTS_TYPE}') END"
    )
    parsed = computed_once(df, {"_json": F.expr(f"try_parse_json({geojson})")})
    parsed = computed_once(parsed, {"_all": F.expr(parts)})
    return computed_once(parsed, {out: F.expr("CASE WHEN size(_all) > 0 THEN _all END")}).drop("_json", "_all")


def first_outer_ring(parts: str) -> Column:
    """Outer ring of the first part."""
    return F.expr(f"get(get({parts}, 0), 0)")


def explode_parts(df: DataFrame, parts: str, keep: list[str], out: str = "polygon") -> DataFrame:
    """One row per part with its outer ring; rows without usable geometry vanish."""
    rings = df.select(*keep, F.explode(parts).alias("_part")).select(*keep, F.get("_part", 0).alias(out))
    return rings.where(usable_ring(out))


def usable_ring(ring: str) -> Column:
    return F.expr(f"{ring} IS NOT NULL AND size({ring}) > 0")


def _with_planar_centroid(df: DataFrame, parts: str, out: str) -> DataFrame:
    """Adds struct ``x, y``: area-weighted centroid, holes subtracted; null without any area.

    Vertices are taken relative to the first one, which keeps the precision of
    small shapes.  Functions inside arrays are interpreted, so every step is kept
    to a few operations on named fields instead of one deep expression.
    """
    ring = "concat(q.ring, slice(q.ring, 1, 1))"
    local = f"transform({ring}, v -> named_struct('x', get(v, 0) - _ox, 'y', get(v, 1) - _oy))"
    edges = (
        "zip_with(q.points, slice(q.points, 2, greatest(size(q.points), 1)), (a, b) -> "
        "named_struct('c', a.x * b.y - b.x * a.y, 'sx', a.x + b.x, 'sy', a.y + b.y))"
    )
    moments = f"transform({edges}, e -> named_struct('c', e.c, 'x', e.sx * e.c, 'y', e.sy * e.c))"

    def total(rows: str, field: str) -> str:
        return f"aggregate({rows}, 0D, (s, m) -> s + coalesce(m.{field}, 0D))"

    sums = ", ".join(f"'{f}', {total('q.moments', f)}" for f in ("c", "x", "y"))
    steps = {
        "_first": f"get(get(get({parts}, 0), 0), 0)",
        "_ox": "get(_first, 0)",
        "_oy": "get(_first, 1)",
        "_rings": f"flatten(transform({parts}, p -> transform(p, (r, i) -> "
        "named_struct('ring', r, 'hole', i > 0))))",
        "_points": f"transform(_rings, q -> named_struct('points', {local}, 'hole', q.hole))",
        "_moments": f"transform(_points, q -> named_struct('moments', {moments}, 'hole', q.hole))",
        "_sums": f"transform(_moments, q -> named_struct({sums}, 'hole', q.hole))",
        # An outer ring counts with positive area and a hole with negative area, whatever their direction.
        "_signed": "transform(_sums, q -> named_struct('w', if(q.hole, -1D, 1D) * sign(q.c), 'c', q.c, 'x', q.x, 'y', q.y))",
        "_weighted": "transform(_signed, q -> named_struct('c', q.w * q.c, 'x', q.w * q.x, 'y', q.w * q.y))",
        "_area": f"3 * {total('_weighted', 'c')}",
        out: f"CASE WHEN {parts} IS NOT NULL THEN named_struct("
        f"'x', try_divide({total('_weighted', 'x')}, _area) + _ox, "
        f"'y', try_divide({total('_weighted', 'y')}, _area) + _oy) END",
    }
    kept = df.columns
    for name, step in steps.items():
        df = df.withColumn(name, F.expr(step))
    return df.select(*kept, out)


def with_centroid(df: DataFrame, parts: str, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Adds the centroid computed directly in degrees."""
    placed = _with_planar_centroid(df, parts, "_centroid")
    return computed_once(placed, {lat: F.col("_centroid.y"), lon: F.col("_centroid.x")}).drop("_centroid")


def with_projected_centroid(
    df: DataFrame, parts: str, lat: str = "lat", lon: str = "lon", zone: int = 15
) -> DataFrame:
    """Adds the centroid computed in the UTM plane and turned back into degrees."""
    plane = f"transform({parts}, p -> transform(p, r -> {utm_forward_sql('r', zone)}))"
    placed = _with_planar_centroid(computed_once(df, {"_plane": F.expr(plane)}), "_plane", "_centroid")
    turned = placed.withColumn("_degrees", F.expr(utm_inverse_sql("_centroid.x", "_centroid.y", zone)))
    return computed_once(turned, {lat: F.col("_degrees.lat"), lon: F.col("_degrees.lon")}).drop(
        "_plane", "_centroid", "_degrees"
    )


def to_geojson(parts: str) -> Column:
    """GeoJSON text: Polygon for a single part, MultiPolygon otherwise."""
    return F.expr(
        f"CASE WHEN size({parts}) = 1 THEN "
        f"to_json(named_struct('type', 'Polygon', 'coordinates', get({parts}, 0))) "
        f"WHEN size({parts}) > 1 THEN "
        f"to_json(named_struct('type', 'MultiPolygon', 'coordinates', {parts})) END"
    )
