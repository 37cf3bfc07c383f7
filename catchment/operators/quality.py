"""Completeness and key checks that replace eyeballing the tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catchment.operators.keys import county_of, key_sides

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")


def completeness_report(
    df: DataFrame, name: str, columns: Sequence[str] | None = None, distinct: Sequence[str] = ()
) -> DataFrame:
    """One row per column: type, rows, nulls, zeros and, for listed columns, distinct values.

    All figures come from a single aggregation over the table.  Distinct values of several columns
    are counted column by column, each from a scan of that column alone, as one aggregation would repeat every
    row per column.
    """
    kinds = dict(df.dtypes)
    checked = list(columns or df.columns)
    figures = [F.count("*").alias("rows")]
    for i, c in enumerate(checked):
        figures.append(F.count_if(F.col(c).isNull()).alias(f"nulls_{i}"))
        zero = F.count_if(F.col(c) == 0) if _numeric(kinds[c]) else F.lit(None).cast("bigint")
        figures.append(zero.alias(f"zeros_{i}"))
        alone = c in distinct and len(distinct) == 1
        figures.append((F.countDistinct(c) if alone else F.lit(None).cast("bigint")).alias(f"distinct_{i}"))
    lines = [
        F.struct(
            F.lit(name).alias("table_name"),
            F.lit(c).alias("column_name"),
            F.lit(kinds[c]).alias("data_type"),
            F.lit(len(df.columns)).alias("column_count"),
            F.col("rows").alias("row_count"),
            F.col(f"distinct_{i}").alias("distinct_count"),
            F.col(f"nulls_{i}").alias("null_count"),
            F.col(f"zeros_{i}").alias("zero_count"),
        )
        for i, c in enumerate(checked)
    ]
    report = df.agg(*figures).select(F.inline(F.array(*lines)))
    if len(distinct) < 2:
        return report
    counted = reduce(DataFrame.unionAll, [distinct_count(df, c) for c in checked if c in distinct])
    known = report.drop("distinct_count").join(counted, "column_name", "left")
    return known.select(*report.columns)


def distinct_count(df: DataFrame, column: str) -> DataFrame:
    """``column_name, distinct_count``: its values but null, each counted once."""
    values = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.lit(1).alias("one"))
    return values.agg(F.lit(column).alias("column_name"), F.count("one").alias("distinct_count"))


def _numeric(kind: str) -> bool:
    return kind in NUMERIC or kind.startswith("decimal")


def sample_values(df: DataFrame, column: str, n: int = 3) -> DataFrame:
    """The n smallest values of a column, as a fixed stand-in for the first rows."""
    return df.select(F.col(column).cast("string").alias("sample")).orderBy("sample").limit(n)


def key_alignment(left: DataFrame, right: DataFrame, key: str = "geoid") -> DataFrame:
    """``side, keys`` with one row for left_only, right_only and both, zeros included."""
    counted = key_sides(left, right, key).groupBy("side").count()
    sides = left.sparkSession.createDataFrame([("both",), ("left_only",), ("right_only",)], "side string")
    return sides.join(counted, "side", "left").select("side", F.coalesce("count", F.lit(0)).alias("keys"))


def key_examples(left: DataFrame, right: DataFrame, key: str = "geoid", n: int = 5) -> DataFrame:
    """Up to n smallest keys of each side that has no partner."""
    sides = key_sides(left, right, key)
    picks = [sides.where(F.col("side") == s).orderBy(key).limit(n) for s in ("left_only", "right_only")]
    return reduce(DataFrame.unionAll, picks)


def alignment_verdict(left: DataFrame, right: DataFrame, key: str = "geoid") -> DataFrame:
    """One row of counts and a sentence about left keys that have no partner."""
    sides = key_sides(left, right, key)
    counts = sides.agg(
        *[F.count_if(F.col("side") == s).alias(s) for s in ("left_only", "right_only", "both")]
    )
    return counts.withColumn(
        "verdict",
        F.when(F.col("left_only") > 0, "some areas lack demographic data").otherwise("all areas have demographic data"),
    )


def join_check(
    areas: DataFrame, demographics: DataFrame, key: str = "geoid", county: str | None = None, sample: int | None = None
) -> DataFrame:
    """Counts rows of a county, and how many of them find a partner.

    With ``sample`` only the first rows by key are looked at.
    """
    left = areas if county is None else areas.where(county_of(key) == county)
    left = left.select(key)
    if sample is not None:
        left = left.orderBy(key).limit(sample)
    right = demographics.select(F.col(key).alias("_partner"))
    joined = left.join(right, F.col(key) == F.col("_partner"), "left")
    return joined.agg(F.count("*").alias("rows"), F.count("_partner").alias("matched"))


def join_verdict(
    areas: DataFrame, demographics: DataFrame, key: str = "geoid", county: str | None = None, sample: int | None = None
) -> DataFrame:
    checked = join_check(areas, demographics, key, county, sample)
    return checked.withColumn(
        "verdict", F.when(F.col("rows") == F.col("matched"), "all keys match").otherwise("some keys do not match")
    )
