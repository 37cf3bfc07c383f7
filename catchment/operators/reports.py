"""Summaries and display tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catchment.functions.labels import (
    area_label,
    coordinate_text,
    count_text,
    percent_text,
    population_label,
    type_label,
)
from catchment.operators.areas import DEFAULT_SITE_TYPES, flag_selected, not_selected
from catchment.operators.statistics import bracket_figures, median_row

# Fields of an area description and how each is written (fixed values).
DESCRIPTION_FIELDS = (
    ("POP", "count"),
    ("Median_HH_Income", "count"),
    ("Low_Income_Rate", "rate"),
    ("Child_Dependency_Rate", "rate"),
    ("Elderly_Dependency_Rate", "rate"),
    ("Renter_Rate", "rate"),
    ("Vacancy_Rate", "rate"),
    ("No_Internet_Rate", "rate"),
)


def load_summary(df: DataFrame) -> DataFrame:
    """Rows, people, median income and unweighted mean rates of a demographic table, in two passes."""
    figures = df.agg(
        F.count("*").alias("block_groups"),
        F.sum("POP").alias("total_population"),
        F.avg("Low_Income_Rate").alias("mean_low_income_rate"),
        F.avg("SNAP_Rate").alias("mean_snap_rate"),
        *bracket_figures("Median_HH_Income"),
    )
    known = figures.first()
    median = median_row(df, "Median_HH_Income", known.ends, known.n, "median_income").first()[0]
    shown = df.sparkSession.createDataFrame([known], figures.schema)
    return shown.drop("ends", "n").withColumn("median_income", F.lit(median).cast("double"))


def county_totals(df: DataFrame, county: str = "countyfp", population: str = "population") -> DataFrame:
    """Areas and people per county, plus a total line."""
    return (
        df.rollup(county)
        .agg(
            F.grouping(county).cast("int").alias("is_total"),
            F.count("*").alias("block_groups"),
            F.sum(population).alias("population"),
        )
        .select(F.when(F.col("is_total") == 1, "Total").otherwise(F.col(county)).alias("area"), "block_groups",
                "population", "is_total")
    )


def affected_summary(demand: DataFrame, population: str = "population") -> DataFrame:
    return demand.agg(
        F.count("*").alias("areas"), F.coalesce(F.sum(population), F.lit(0)).alias("people")
    ).withColumn("people_text", count_text("people"))


def view_center(areas: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    return areas.agg(F.avg(lat).alias("center_lat"), F.avg(lon).alias("center_lon"))


def results_table(chosen: DataFrame) -> DataFrame:
    """Chosen sites as people read them."""
    return chosen.select(
        "rank",
        F.col("name").alias("Name"),
        type_label("type").alias("Type"),
        coordinate_text("lat").alias("Latitude"),
        coordinate_text("lon").alias("Longitude"),
    )


def metrics_text(summary: DataFrame) -> DataFrame:
    """The four headline figures as text."""
    return summary.select(
        count_text("total_population").alias("affected_population"),
        count_text("covered_population").alias("covered_population"),
        percent_text("coverage_percent").alias("coverage"),
        F.col("selected_count").cast("string").alias("centers_selected"),
    )


def area_features(polygons: DataFrame, affected: DataFrame, key: str = "geoid", population: str = "population") -> DataFrame:
    """Polygons with the affected flag and two labels, ready for drawing."""
    return flag_selected(polygons, affected, key).withColumns(
        {"name": area_label(key), "type_display": population_label(population)}
    )


def site_features(sites: DataFrame, chosen: DataFrame, types: Sequence[str] = DEFAULT_SITE_TYPES) -> DataFrame:
    """Sites still open to choice and the chosen ones, in one table told apart by ``layer``.

    ``layer`` is the site type, or ``selected``; writing it partitioned by ``layer``
    gives one set of files per kind, and kinds without sites give none.
    """
    shown = ["site_id", "name", "type", "lat", "lon"]
    listed = sites.where(F.col("type").isin(list(types))).select(*shown)
    rest = not_selected(listed, chosen).withColumn("layer", F.col("type"))
    picked = chosen.select(*shown).withColumn("layer", F.lit("selected"))
    return rest.unionByName(picked).withColumn("type_display", type_label("type"))


def describe_areas(df: DataFrame, geoid: str = "GEOID", rate_unit: str = "percent", out: str = "description") -> DataFrame:
    """Adds a text of all fields that are present and known."""
    lines = [F.concat(F.lit("GEOID: "), F.coalesce(F.col(geoid), F.lit("N/A")))]
    if "Location" in df.columns:
        lines.append(F.concat(F.lit("Location: "), F.col("Location")))
    for name, kind in DESCRIPTION_FIELDS:
        if name in df.columns:
            text = count_text(name) if kind == "count" else percent_text(name, rate_unit)
            lines.append(F.concat(F.lit(f"{name}: "), text))
    return df.withColumn(out, F.concat_ws("; ", *lines))


def write_features(features: DataFrame, path: str, by: str | None = None) -> None:
    """Writes a feature table as JSON lines, optionally one folder per kind."""
    writer = features.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).json(path)
