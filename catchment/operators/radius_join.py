"""Pairs of sites and areas within a radius."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catchment.functions.geodesy import haversine_sql, side, unit_vector_sql, usable_point, within_sql
from catchment.operators.grid import Grid
from catchment.operators.skew import (
    MOST_PAIRS,
    MOST_REPEATS,
    Step,
    classes,
    class_counts,
    cut_keys,
    dealt_join,
    few,
    key_counts,
    split_join,
    task_number,
    with_cells,
)
from catchment.session import ensure_checkpoint_dir


def bare(df: DataFrame, prefix: str, lat: str, lon: str, keep: Sequence[str]) -> DataFrame:
    """Rows with usable coordinates as prefixed ``lat, lon`` plus the kept columns."""
    lat, lon = f"cast({lat} AS double)", f"cast({lon} AS double)"
    return df.where(usable_point(lat, lon)).selectExpr(*keep, f"{lat} AS {prefix}lat", f"{lon} AS {prefix}lon")


def pointed(prefix: str) -> Step:
    """Adds the prefixed ``x, y, z``, which follow from the coordinates and need not be moved."""
    vector = [f"{v} AS {prefix}{axis}" for v, axis in zip(unit_vector_sql(f"{prefix}lat", f"{prefix}lon"), "xyz")]
    return lambda df: df.selectExpr("*", *vector)


def placed(df: DataFrame, prefix: str, lat: str, lon: str, keep: Sequence[str]) -> DataFrame:
    """Rows with usable coordinates as prefixed ``lat, lon, x, y, z`` plus the kept columns."""
    return pointed(prefix)(bare(df, prefix, lat, lon, keep))


# Equal rows of crowded blocks that are moved to be merged, on average.
MANY_COPIES = 2
# Columns that pairs of a task share.
TOGETHER = ["_home", "_left_part", "_right_part", "_task"]


def _homes(demand: DataFrame, reach: DataFrame, by: str) -> tuple[DataFrame, DataFrame, bool]:
    """Both sides with ``_home``, the first block of all areas with the same ``by``; sites come to each home of a block.

    Also whether any home is another block than the area's own; sites have the reached block as ``_reached`` then.
    """
    spans = demand.groupBy(F.col(by).alias("_by")).agg(F.min("block").alias("_home"), F.max("block").alias("_last"))
    moved = spans.where("_home < _last").select("_by", "_home").checkpoint()
    if moved.isEmpty():
        return demand.withColumn("_home", F.col("block")), reach.withColumnRenamed("block", "_home"), False
    columns = [f"`{c}`" for c in demand.columns]
    demand = demand.join(moved, F.col(by).eqNullSafe(F.col("_by")), "left").selectExpr(*columns, "coalesce(_home, block) AS _home")
    homes = demand.select("block", "_home").distinct()
    return demand, reach.join(homes, "block").withColumnRenamed("block", "_reached"), True


def radius_join(
    areas: DataFrame,
    sites: DataFrame,
    radius_miles: float,
    area_columns: Sequence[str] = ("geoid", "population"),
    site_columns: Sequence[str] = ("site_id",),
    lat: str = "lat",
    lon: str = "lon",
    most_pairs: int = MOST_PAIRS,
    together: tuple[str, str] | None = None,
) -> DataFrame:
    """Every (site, area) pair at most ``radius_miles`` apart, with ``distance_miles``.

    Sites are repeated into the blocks their disc touches, areas have exactly one
    block, so the equi-join on the block yields each pair once.  Blocks with more than
    ``most_pairs`` candidate pairs are found in a first pass that reads coordinates only.  There rows are
    cut into parts on both sides; where many are equal they become classes first, tested once per pair of classes, and
    repeated afterwards.  Without such blocks nothing of that is in the plan.  Parts repeat rows a bounded
    number of times, within their task unless a block has more than ``MOST_PAIRS``.  The same pass counts all pairs, by which the join is dealt to tasks.

    ``together`` names an area and a site column.  Then all pairs with the same values of both come
    from one task, and the columns ``TOGETHER`` say so: a grouping by the two and by these moves no pair.
    Areas of one value in several blocks then meet the sites of all of them in the first one.
    """
    shared = set(area_columns) & set(site_columns)
    if shared:
        raise ValueError(f"columns on both sides: {sorted(shared)}")
    grid = Grid(radius_miles)
    demand = grid.locate(bare(areas, "d_", lat, lon, area_columns), "d_lat", "d_lon").drop("sub_row", "sub_col")
    reach = grid.reach(bare(sites, "s_", lat, lon, site_columns), "s_lat", "s_lon")
    within = within_sql(side("s_"), side("d_"), radius_miles)
    ensure_checkpoint_dir(areas.sparkSession)
    key, extra = "block", []
    area_by, site_by = ["d_lat", "d_lon", *area_columns], ["s_lat", "s_lon", *site_columns]
    if together:
        key, extra = "_home", TOGETHER
        area_by, site_by = [together[0]], [together[1]]
        demand, reach, moved = _homes(demand, reach, together[0])
        if moved:  # not an equality, as the join is to know of the home alone
            within += " AND block - _reached = 0L"
    counted = key_counts(demand, reach, [key]).where("_left > 0 AND _right > 0").checkpoint()
    crowded, tasks, then = cut_keys(counted, [key], most_pairs).select(key), task_number(counted), (pointed("d_"), pointed("s_"))
    if crowded.isEmpty():
        pairs = dealt_join(demand, reach, [key], tasks, then=then).where(within).selectExpr("*", "0 AS _left_part", "0 AS _right_part", "0 AS _task")
    else:
        crowded = few(crowded)
        numbers = class_counts(demand.join(crowded, key, "left_semi"), reach.join(crowded, key, "left_semi"), [key]).checkpoint()
        rows = numbers.agg(*[F.sum(c).alias(c) for c in ("_left_rows", "_left", "_right_rows", "_right")]).first()
        # Equal rows are brought together only where there are many.
        merged = [c for c in ("left", "right") if rows[f"_{c}_rows"] > MANY_COPIES * rows[f"_{c}"]]
        left = classes(demand, crowded, [key], "left") if "left" in merged else demand
        right = classes(reach, crowded, [key], "right") if "right" in merged else reach
        if not together:
            area_by, site_by = area_by + ["_left_class"] * ("left" in merged), site_by + ["_right_class"] * ("right" in merged)
        parts = cut_keys(numbers, [key], most_pairs, MOST_REPEATS)
        parts = few(with_cells(parts, numbers, [key], max(most_pairs, MOST_PAIRS), MOST_REPEATS).checkpoint())
        pairs = split_join(left, right, [key], area_by, site_by, parts, tasks, keep_parts=True, then=then).where(within)
        if merged:
            copies = " * ".join(f"_{c}_copies" for c in merged)
            pairs = pairs.withColumn("_copy", F.expr(f"explode(sequence(1L, {copies}))"))
    return pairs.selectExpr(
        *site_columns,
        *area_columns,
        f"{haversine_sql('s_lat', 's_lon', 'd_lat', 'd_lon')} AS distance_miles",
        *extra,
    )
