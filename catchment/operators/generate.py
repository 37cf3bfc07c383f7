"""Reproducible synthetic sites and demographics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catchment.functions.hashing import between_sql, normal_sql, uniform_sql
from catchment.functions.rates import truncated_share_sql
from catchment.operators.demographics import existing_columns, with_location
from catchment.schemas import CANDIDATE_POINTS

# Anchor sites (fixed values).
BASE_SITES = (
    ("church_1", 38.6359, -90.2211),
    ("church_2", 38.6277, -90.1994),
    ("school_1", 38.6460, -90.2547),
    ("school_2", 38.6089, -90.2368),
    ("community_1", 38.6701, -90.2846),
    ("community_2", 38.5964, -90.2253),
)
# Box around the metropolitan area (fixed values): south, north, west, east.
METRO_BOX = (38.40, 38.90, -90.74, -90.12)

# County averages of the synthetic demographics (fixed values).
MEAN_POPULATION, POPULATION_SPREAD = 1340.0, 402.0
MEAN_INCOME, INCOME_SPREAD = 81441.0, 15000.0
HOUSEHOLD_SIZE = 2.5
LEAST_POPULATION, LEAST_HOUSEHOLDS = 100, 40

# Counts as a share of households or of people (fixed values).
HOUSEHOLD_SHARES = {
    "Low_Income_HH": 0.097,
    "HH_SNAP": 0.065,
    "Public_Assistance_HH": 0.02,
    "HH_With_Children": 0.28,
    "Single_Parent_HH": 0.08,
    "Renter_Occupied": 0.31,
    "Vacant_Housing_Units": 0.08,
    "HH_No_Internet": 0.04,
}
PEOPLE_SHARES = {
    "Children_0_17": 0.18,
    "Children_0_4": 0.045,
    "Children_5_17": 0.135,
    "Elderly_65_Plus": 0.17,
    "Elderly_65_74": 0.10,
    "Elderly_75_Plus": 0.07,
    "Total_Workers": 0.40,
}
NO_CAR_SHARE = 0.08
# Rates that are the same for every area (fixed values).
CONSTANT_RATES = {
    "Low_Income_Rate": 9.7,
    "SNAP_Rate": 6.5,
    "Public_Assistance_Rate": 2.0,
    "Child_Dependency_Rate": 18.0,
    "Elderly_Dependency_Rate": 17.0,
    "Total_Dependency_Rate": 35.0,
    "HH_With_Children_Rate": 28.0,
    "Single_Parent_Rate": 8.0,
    "Renter_Rate": 31.0,
    "Vacancy_Rate": 8.0,
    "Old_Housing_Rate": 0.0,
    "No_Car_Rate": 8.0,
    "No_Internet_Rate": 4.0,
}


def base_sites(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(BASE_SITES), CANDIDATE_POINTS)


def scatter_sites(
    ids: DataFrame,
    id_column: str = "id",
    jitter_deg: float = 0.035,
    box: tuple[float, float, float, float] | None = METRO_BOX,
    uniform_ratio: float = 0.30,
    include_base: bool = True,
    seed: int = 42,
) -> DataFrame:
    """One site per id: uniform in the box, or near a random anchor site.

    Without a box all sites are placed near anchors.  The anchors themselves come last.
    """
    ratio = uniform_ratio if box is not None else 0.0
    south, north, west, east = box or METRO_BOX
    anchors = ", ".join(f"named_struct('lat', {lat!r}D, 'lon', {lon!r}D)" for _, lat, lon in BASE_SITES)
    pick = f"cast(floor({uniform_sql(seed, 'anchor', id_column)} * {len(BASE_SITES)}) AS int)"
    jitter = (f"{-jitter_deg!r}D", f"{jitter_deg!r}D")
    placed = ids.selectExpr(
        f"{id_column} AS _id",
        f"({uniform_sql(seed, 'kind', id_column)}) < {ratio!r}D AS _free",
        f"get(array({anchors}), {pick}) AS _anchor",
        f"{between_sql(seed, 'lat', id_column, f'{south!r}D', f'{north!r}D')} AS _box_lat",
        f"{between_sql(seed, 'lon', id_column, f'{west!r}D', f'{east!r}D')} AS _box_lon",
        f"{between_sql(seed, 'jitter-lat', id_column, *jitter)} AS _up",
        f"{between_sql(seed, 'jitter-lon', id_column, *jitter)} AS _right",
    ).selectExpr(
        "concat('site_', if(_free, 'rand', 'jitter'), '_', cast(_id + 1 AS string)) AS site_id",
        "if(_free, _box_lat, _anchor.lat + _up) AS lat",
        "if(_free, _box_lon, _anchor.lon + _right) AS lon",
    )
    return placed.unionByName(base_sites(ids.sparkSession)) if include_base else placed


def generate_candidates(spark: SparkSession, n: int = 500, **options) -> DataFrame:
    return scatter_sites(spark.range(n), "id", **options)


def synthesize_demographics(
    geoids: DataFrame, geoid: str = "geoid", place: str = "St. Louis County, Missouri", seed: int = 42
) -> DataFrame:
    """The full demographic table for known areas, drawn around county averages."""
    people = normal_sql(seed, "population", geoid, MEAN_POPULATION, POPULATION_SPREAD)
    income = normal_sql(seed, "income", geoid, MEAN_INCOME, INCOME_SPREAD)
    df = geoids.selectExpr(
        f"cast({geoid} AS string) AS GEOID",
        f"greatest({LEAST_POPULATION}L, cast({people} AS bigint)) AS POP",
        f"cast({income} AS bigint) AS Median_HH_Income",
    ).withColumn("Total_Households", F.expr(f"greatest({LEAST_HOUSEHOLDS}L, cast(POP / {HOUSEHOLD_SIZE!r}D AS bigint))"))
    shares = {n: F.expr(truncated_share_sql("Total_Households", s)) for n, s in HOUSEHOLD_SHARES.items()}
    shares |= {n: F.expr(truncated_share_sql("POP", s)) for n, s in PEOPLE_SHARES.items()}
    shares["Workers_No_Car"] = F.expr(
        truncated_share_sql(f"POP * {PEOPLE_SHARES['Total_Workers']!r}D", NO_CAR_SHARE)
    )
    rates = {name: F.lit(value) for name, value in CONSTANT_RATES.items()}
    return existing_columns(
        with_location(df.withColumns(shares | rates | {"Built_Before_1940": F.lit(0).cast("bigint")}), place)
    )
