"""Exact medians without collecting a column in one place."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catchment.sources.cache import FrameCache

# Rank error of the sketch is at most one part in this many.
SKETCH_ACCURACY = 10_000
# Pieces the bracket is cut into, each ordered on its own.
BUCKETS = 1000


def exact_median(df: DataFrame, column: str, out: str = "median", accuracy: int = SKETCH_ACCURACY) -> DataFrame:
    """One row with the interpolated median; null for an empty or all-null column."""
    return exact_medians(df, {out: column}, accuracy)


def exact_medians(df: DataFrame, columns: Mapping[str, str], accuracy: int = SKETCH_ACCURACY) -> DataFrame:
    """One row with the interpolated median of each column, by the names they are to have.

    Two passes for all columns together: mergeable sketches bracket the middles, then only the distinct
    values in the brackets, with their counts, are put in order, piece by piece.  Should a sketch
    err beyond its bound, its bracket is widened and the second pass repeated for that column.
    """
    figures = [f.alias(f"{name}_{i}") for i, c in enumerate(columns.values()) for name, f in zip(("ends", "n"), bracket_figures(c, accuracy))]
    first = df.agg(*figures).first()
    known = {out: (first[f"ends_{i}"], first[f"n_{i}"]) for i, out in enumerate(columns)}
    return _medians(df, columns, known, accuracy)


def bracket_figures(column: str, accuracy: int = SKETCH_ACCURACY) -> list[Column]:
    """Aggregates for a first pass: ``ends`` (extremes and bracket) and ``n``, the known values."""
    margin = 3.0 / accuracy
    number = F.col(column).cast("double")
    bracket = F.percentile_approx(number, [max(0.0, 0.5 - margin), min(1.0, 0.5 + margin)], accuracy)
    ends = F.array(F.min(number), F.get(bracket, F.lit(0)), F.get(bracket, F.lit(1)), F.max(number))
    return [ends.alias("ends"), F.count(number).alias("n")]


def median_row(
    df: DataFrame, column: str, ends: Sequence[float] | None, n: int, out: str = "median", accuracy: int = SKETCH_ACCURACY
) -> DataFrame:
    """The median, given the figures of ``bracket_figures``."""
    return _medians(df, {out: column}, {out: (ends, n)}, accuracy)


def _medians(df: DataFrame, columns: Mapping[str, str], known: Mapping[str, tuple], accuracy: int) -> DataFrame:
    medians: dict[str, float | None] = dict.fromkeys(columns)
    brackets = {out: (ends[1], ends[2]) for out, (ends, n) in known.items() if n}
    while brackets:
        ranks = {out: ((known[out][1] + 1) // 2, (known[out][1] + 2) // 2) for out in brackets}
        with FrameCache() as cache:
            found = _at_ranks(df, [(columns[out], *brackets[out], *ranks[out]) for out in brackets], cache)
        for out, (low, high), at in zip(ranks, list(brackets.values()), found):
            if None not in at:
                medians[out] = sum(at) / 2
                del brackets[out]
                continue
            least, most = known[out][0][0], known[out][0][3]
            if low <= least and high >= most:
                raise RuntimeError(f"{columns[out]} has changed since it was counted")
            width = max(high - low, (most - least) / accuracy)
            brackets[out] = max(least, low - 8 * width), min(most, high + 8 * width)
    return df.sparkSession.createDataFrame([tuple(medians.values())], ", ".join(f"`{out}` double" for out in columns))


def _at_ranks(df: DataFrame, sought: list[tuple], cache: FrameCache) -> list[tuple[float | None, float | None]]:
    """For each (column, low, high, rank, rank): values at the ranks, counted from 1; None for one outside of the bracket."""
    def per_column(values: list[float]) -> Column:
        return F.element_at(F.array(*[F.lit(float(v)) for v in values]), F.col("column"))

    cells = [F.struct(F.lit(i).alias("column"), F.col(c).cast("double").alias("v")) for i, (c, *_) in enumerate(sought, 1)]
    values = df.select(F.inline(F.array(*cells))).where("v IS NOT NULL")
    low, high = per_column([s[1] for s in sought]), per_column([s[2] for s in sought])
    # Values below the bracket only count, so they share one group, in bucket 0.
    share = F.coalesce(F.try_divide(F.col("v") - low, high - low), F.lit(0.0))
    bucket = F.when(F.col("v") < low, 0).otherwise(1 + F.floor(share * BUCKETS)).cast("int")
    placed = values.where(F.col("v") <= high).select("column", bucket.alias("bucket"), F.when(F.col("v") >= low, F.col("v")).alias("v"))
    # Kept, as it is read twice: for the sums of the buckets and for their values.
    grouped = cache.get("grouped", lambda: placed.groupBy("column", "bucket", "v").agg(F.count("*").alias("rows")))
    # At most BUCKETS + 2 rows per column, so these windows and the broadcast stay small.
    before = Window.partitionBy("column").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        grouped.groupBy("column", "bucket")
        .agg(F.sum("rows").alias("rows"))
        .select("column", "bucket", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))
    )
    upto = Window.partitionBy("column", "bucket").orderBy("v")
    ranked = grouped.join(F.broadcast(offsets), ["column", "bucket"]).withColumn("last", F.col("offset") + F.sum("rows").over(upto))

    def at(column: int, rank: int) -> Column:
        here = (F.col("column") == column) & (F.col("last") >= rank) & (F.col("last") - F.col("rows") < rank)
        return F.max(F.when(here, F.col("v")))

    row = ranked.agg(*[at(i, r).alias(f"r{i}_{k}") for i, s in enumerate(sought, 1) for k, r in enumerate(s[3:])]).first()
    return [(row[f"r{i}_0"], row[f"r{i}_1"]) for i in range(1, len(sought) + 1)]
