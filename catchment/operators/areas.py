"""Boundary tables combined with demographic tables, and their filters."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Types that may open (fixed values).
DEFAULT_SITE_TYPES = ("school", "place_of_worship", "community_centre", "fire_station", "library")


def merge_population(
    boundaries: DataFrame,
    sources: Sequence[DataFrame],
    key: str = "geoid",
    value: str = "pop",
    out: str = "population",
) -> DataFrame:
    """Adds the first non-null value of the sources, in order of priority, else 0.

    A zero in an earlier source wins over a later one; duplicates of a key in a
    source repeat the boundary row, as in any outer join.
    """
    df = boundaries.withColumn(key, F.col(key).cast("string"))
    names = []
    for i, source in enumerate(sources):
        name = f"_value_{i}"
        names.append(name)
        df = df.join(source.select(F.col(key).cast("string").alias(key), F.col(value).alias(name)), key, "left")
    return df.withColumn(out, F.coalesce(*names, F.lit(0)).cast("bigint")).drop(*names)


def enrich(boundaries: DataFrame, demographics: DataFrame, key: str = "geoid") -> DataFrame:
    """Boundaries with all demographic columns, unmatched areas kept."""
    right = demographics.withColumn(key, F.col(key).cast("string"))
    return boundaries.withColumn(key, F.col(key).cast("string")).join(right, key, "left")


def keep_keys(df: DataFrame, keys: DataFrame | Iterable[str], key: str = "geoid") -> DataFrame:
    """Rows whose key is listed, either in a table of any size or in a Python list."""
    if not isinstance(keys, DataFrame):
        keys = df.sparkSession.createDataFrame([(k,) for k in sorted({str(k) for k in keys})], f"{key} string")
    return df.join(keys.select(F.col(key).cast("string").alias(key)), key, "left_semi")


def keep_types(sites: DataFrame, types: Sequence[str] = DEFAULT_SITE_TYPES) -> DataFrame:
    return sites.where(F.col("type").isin(list(types)))


def not_selected(sites: DataFrame, selected: DataFrame, key: str = "site_id") -> DataFrame:
    return sites.join(selected.select(key), key, "left_anti")


def flag_selected(df: DataFrame, selected: DataFrame, key: str = "geoid", out: str = "selected") -> DataFrame:
    """Adds a boolean: is the key of this row among the selected ones."""
    marks = selected.select(key).distinct().withColumn(out, F.lit(True))
    return df.join(marks, key, "left").withColumn(out, F.coalesce(out, F.lit(False)))
