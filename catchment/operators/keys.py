"""Geographic identifiers: state(2) + county(3) + tract(6) + block group(1)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COUNTIES = ("510", "189")


def county_of(geoid: str) -> Column:
    return F.substring(geoid, 3, 3)


def build_geoid(*parts: str) -> Column:
    """Concatenates the codes; three parts name a tract, four a block group."""
    return F.concat(*[F.col(p) for p in parts])


def split_geoid(df: DataFrame, geoid: str = "geoid") -> DataFrame:
    """Adds ``statefp, countyfp, tractce, blkgrpce``."""
    spans = {"statefp": (1, 2), "countyfp": (3, 3), "tractce": (6, 6), "blkgrpce": (12, 1)}
    return df.withColumns({name: F.substring(geoid, *span) for name, span in spans.items()})


def valid_geoid(geoid: str, digits: int = 12) -> Column:
    return F.coalesce(F.col(geoid).rlike(f"^[0-9]{{{digits}}}$"), F.lit(False))


def keep_counties(df: DataFrame, counties: Sequence[str] = COUNTIES, column: str = "countyfp") -> DataFrame:
    return df.where(F.col(column).isin(list(counties)))


def distinct_sorted_keys(df: DataFrame, key: str = "geoid", county: str | None = None) -> DataFrame:
    """Distinct keys in order, optionally of one county only."""
    if county is not None:
        df = df.where(county_of(key) == county)
    return df.select(key).distinct().orderBy(key)


def first_keys(df: DataFrame, n: int, key: str = "geoid", last: bool = False) -> DataFrame:
    """The n rows with the smallest, or largest, keys."""
    return df.orderBy(F.desc(key) if last else F.asc(key)).limit(n)


def union_first_wins(sources: Sequence[DataFrame], key: str = "geoid") -> DataFrame:
    """One row per key from the earliest source that has it.

    Rows of one source with the same key are told apart by their values, so the
    result does not depend on the order in which files are read.
    """
    names = sources[0].columns
    rest = [c for c in names if c != key]
    ranked = [s.select(key, F.struct(F.lit(i).alias("_rank"), *rest).alias("_row")) for i, s in enumerate(sources)]
    stacked = ranked[0]
    for other in ranked[1:]:
        stacked = stacked.unionByName(other)
    return stacked.groupBy(key).agg(F.min("_row").alias("_row")).select(
        *[F.col(c) if c == key else F.col(f"_row.{c}").alias(c) for c in names]
    )


def key_sides(left: DataFrame, right: DataFrame, key: str = "geoid") -> DataFrame:
    """Each distinct key with ``side``: only in the left, only in the right, or both.

    Both tables are stacked and grouped, so this takes one shuffle and repeated
    keys are merged before it.
    """
    marks = left.selectExpr(f"cast({key} AS string) AS {key}", "true AS l", "false AS r").unionAll(
        right.selectExpr(f"cast({key} AS string) AS {key}", "false AS l", "true AS r")
    )
    return (
        marks.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.max("l").alias("l"), F.max("r").alias("r"))
        .select(key, F.expr("CASE WHEN l AND r THEN 'both' WHEN l THEN 'left_only' ELSE 'right_only' END").alias("side"))
    )
