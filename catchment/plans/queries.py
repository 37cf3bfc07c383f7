"""One registered query per operator, each over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catchment import schemas
from catchment.functions import geometry, labels, rates
from catchment.functions.geodesy import haversine_miles
from catchment.operators import (
    areas as area_ops,
    coverage,
    demographics,
    generate,
    keys,
    quality,
    reports,
)
from catchment.operators.radius_join import TOGETHER, radius_join
from catchment.operators.statistics import exact_median, exact_medians
from catchment.plans import inputs
from catchment.plans.service import CoverageService, map_tables
from catchment.session import ensure_checkpoint_dir, fresh_path, remove_path
from catchment.sources import census, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

FLAGSHIP_RADIUS, FLAGSHIP_K = 5.0, 5
PLACE = "St. Louis County, Missouri"


def query(name: str) -> Callable[[Query], Query]:
    def register(build: Query) -> Query:
        QUERIES[name] = build
        return build

    return register


# Short names for the derived inputs.
areas, sites = inputs.areas, inputs.sites


def demand(spark: SparkSession, d: str) -> DataFrame:
    return area_ops.keep_keys(areas(spark, d), inputs.affected(spark, d))


def open_sites(spark: SparkSession, d: str) -> DataFrame:
    return area_ops.keep_types(sites(spark, d))


def flagship(spark: SparkSession, d: str) -> coverage.CoverageRun:
    return coverage.run_coverage(
        areas(spark, d), sites(spark, d), inputs.affected(spark, d), FLAGSHIP_RADIUS, FLAGSHIP_K
    )


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# --- sources, sinks, cache -------------------------------------------------------------


@query("src1_table_scan")
def _(spark, d):
    return tables.read_table(spark, f"{d}/customer.parquet")


@query("src2_named_accessors")
def _(spark, d):
    suffix = uuid.uuid4().hex
    frames = {"sites": sites(spark, d), "demo": inputs.city_demographics(spark, d), "bounds": areas(spark, d)}
    for name, frame in frames.items():
        frame.createOrReplaceTempView(f"{name}_{suffix}")
    got = [
        tables.candidate_sites(spark, f"sites_{suffix}").select(F.lit("sites").alias("source"), F.col("site_id").cast("string").alias("key")),
        tables.demographics(spark, f"demo_{suffix}").select(F.lit("demographics").alias("source"), F.col("geoid").alias("key")),
        tables.boundaries(spark, f"bounds_{suffix}").select(F.lit("boundaries").alias("source"), F.col("geoid").alias("key")),
    ]
    for name in frames:  # the frames are resolved, so the views have served
        spark.catalog.dropTempView(f"{name}_{suffix}")
    return got[0].unionAll(got[1]).unionAll(got[2])


def kept(spark: SparkSession, df: DataFrame, *paths: str) -> DataFrame:
    """The rows, so that the files they were read from can go."""
    ensure_checkpoint_dir(spark)
    rows = df.checkpoint()
    for path in paths:
        remove_path(spark, path)
    return rows


@query("src3_run_sql")
def _(spark, d):
    return tables.run_sql(
        spark, "SELECT geoid, population FROM {areas} WHERE substring(geoid, 3, 3) = '189'", areas=areas(spark, d)
    )


@query("src4_csv_read")
def _(spark, d):
    path = fresh_path(spark, "boundaries-csv")
    source = areas(spark, d).select("geoid", "statefp", "countyfp", "tractce", "blkgrpce", "lat", "lon", "geom_geojson")
    tables.write_csv(source, path)
    return kept(spark, tables.read_boundaries_csv(spark, path).toDF(*source.columns), path)


@query("src5_load_files")
def _(spark, d):
    folder, suffix = fresh_path(spark, "load"), uuid.uuid4().hex
    tables.write_csv(open_sites(spark, d).select("site_id", "lat", "lon"), f"{folder}/sites.csv")
    report = tables.load_files(
        spark,
        {
            f"candidates_{suffix}": (f"{folder}/sites.csv", schemas.CANDIDATE_POINTS),
            f"absent_{suffix}": (f"{folder}/absent.csv", schemas.TRACT_POPULATION),
        },
        folder=f"{folder}/tables",
    )
    shown = report.select(F.substring_index("table_name", "_", 1).alias("table_name"), "status", "row_count")
    spark.sql(f"DROP TABLE candidates_{suffix}")
    return kept(spark, shown, folder)


@query("src5_load_rejects")
def _(spark, d):
    """A file in which every seventh latitude is no number: rows loaded, lines rejected, and what was stored of both."""
    folder, name = fresh_path(spark, "load"), f"rejects_{uuid.uuid4().hex}"
    lat = F.when(F.col("site_id") % 7 == 0, "north").otherwise(F.col("lat").cast("string"))
    tables.write_csv(sites(spark, d).select("site_id", lat.alias("lat"), "lon"), f"{folder}/sites.csv")
    report = tables.load_files(spark, {name: (f"{folder}/sites.csv", schemas.CANDIDATE_POINTS)}, folder=f"{folder}/tables")
    stored = tables.read_table(spark, name).agg(F.count("*").alias("stored_rows"), F.sum("lat").alias("stored_lat"))
    lines = tables.read_table(spark, f"{name}_rejected").agg(F.count_if(F.col("line").contains(",north,")).alias("stored_lines"))
    shown = kept(spark, report.select("status", "row_count", "rejected_count").join(stored).join(lines))
    for table in (name, f"{name}_rejected"):
        spark.sql(f"DROP TABLE {table}")
    return kept(spark, rounded(shown, "stored_lat"), folder)


@query("src6_census_rejects")
def _(spark, d):
    """Damaged responses: what is decoded and what is rejected, by reason, are together all that was received."""
    responses = inputs.damaged_responses(spark, d, census.ACS_VARIABLES)
    decoded = census.decode_block_groups(responses).agg(F.lit("decoded").alias("reason"), F.count("*").alias("rows"))
    rejected = census.response_rejects(responses, "response").groupBy("reason").agg(F.count("*").alias("rows"))
    return decoded.unionAll(rejected)


@query("src6_census_decode")
def _(spark, d):
    return census.decode_block_groups(inputs.census_responses(spark, d, census.ACS_VARIABLES))


@query("src6_tract_decode")
def _(spark, d):
    variables = {"B11001_001E": "Total_Households", "B01001_001E": "POP"}
    return census.decode_tracts(inputs.census_responses(spark, d, variables))


@query("src6_census_decode_cells")
def _(spark, d):
    return _decoded_cells(spark, d)


def _decoded_cells(spark: SparkSession, d: str) -> DataFrame:
    """All cell variables; a count that cannot be read is null."""
    responses = inputs.census_responses(spark, d, dict(sorted(census.ACS_CELL_VARIABLES.items())))
    return census.decode_block_groups(responses, variables=census.ACS_CELL_VARIABLES, bad_is_zero=False)


@query("src6_cells_to_metrics")
def _(spark, d):
    """Responses decoded, renamed and turned into the full table; they say nothing of housing age."""
    return demographics.demographic_table(_decoded_cells(spark, d), PLACE, "cells", absent=demographics.HOUSING_AGE)


@query("src7_rename_coded")
def _(spark, d):
    coded = inputs.counts(spark, d).select("geoid", *[F.col(n).alias(c) for c, n in census.ACS_VARIABLES.items()])
    return census.rename_coded(coded, census.ACS_VARIABLES)


def _written(spark: SparkSession, frames: list[DataFrame], modes: list[str]) -> DataFrame:
    path, name = fresh_path(spark, "table"), f"written_{uuid.uuid4().hex}"
    for frame, mode in zip(frames, modes):
        tables.write_table(frame, name, mode, path)
    rows = kept(spark, tables.read_table(spark, name), path)
    spark.sql(f"DROP TABLE {name}")
    return rows


@query("snk1_table_replace")
def _(spark, d):
    frames = [inputs.county_demographics(spark, d), inputs.city_demographics(spark, d)]
    return _written(spark, frames, ["overwrite", "overwrite"])


@query("snk1_bucketed_merge")
def _(spark, d):
    """Boundaries and both demographic tables stored in equal buckets, then merged without moving rows."""
    suffix, folder = uuid.uuid4().hex, fresh_path(spark, "buckets")
    frames = {"bounds": areas(spark, d).select("geoid", "lat", "lon"), "city": inputs.city_demographics(spark, d),
              "county": inputs.county_demographics(spark, d)}
    for name, frame in frames.items():
        tables.write_table(frame, f"{name}_{suffix}", path=f"{folder}/{name}", buckets=("geoid", 8))
    stored = {name: tables.read_table(spark, f"{name}_{suffix}") for name in frames}
    rows = kept(spark, area_ops.merge_population(stored["bounds"], [stored["county"], stored["city"]]), folder)
    for name in frames:
        spark.sql(f"DROP TABLE {name}_{suffix}")
    return rows


@query("snk2_table_append")
def _(spark, d):
    frames = [inputs.city_demographics(spark, d), inputs.county_demographics(spark, d)]
    return _written(spark, frames, ["overwrite", "append"])


@query("snk3_csv_write")
def _(spark, d):
    path = fresh_path(spark, "demographics-csv")
    table = demographics.demographic_table(inputs.estimate_counts(spark, d), PLACE, "estimate")
    tables.write_csv(table, path)
    read = tables.read_demographics_csv(spark, path)
    return kept(spark, read.select("GEOID", "Location", "POP", "SNAP_Rate", "No_Internet_Rate"), path)


@query("snk4_boundary_table")
def _(spark, d):
    return rounded(tables.boundary_table(areas(spark, d)), "lat", "lon")


def service(spark: SparkSession, d: str, require_geometry: bool = False) -> CoverageService:
    return CoverageService(
        boundaries=areas(spark, d).drop("population"),
        city=inputs.city_demographics(spark, d),
        county=inputs.county_demographics(spark, d),
        sites=sites(spark, d),
        require_geometry=require_geometry,
    )


@query("cache2_drawable_areas_only")
def _(spark, d):
    """A request over the areas that can be drawn."""
    shared = service(spark, d, require_geometry=True)
    run = shared.optimize(inputs.affected(spark, d), 5.0, 3)
    summary = kept(spark, rounded(run.summary, "coverage_percent"))
    shared.clear_cache()
    return summary


@query("cache1_shared_frames")
def _(spark, d):
    """Two requests answered from the same kept frames, which are then released."""
    shared = service(spark, d)
    runs = [shared.optimize(inputs.affected(spark, d), radius, 3) for radius in (2.0, 5.0)]
    rows = [(r.selection.radius_miles, *r.summary.first()) for r in runs]
    kind = "radius_miles double, total_population bigint, covered_population bigint, coverage_percent double, selected_count int"
    shared.clear_cache()
    return rounded(spark.createDataFrame(rows, kind), "coverage_percent")


@query("j1_prepared_areas")
def _(spark, d):
    """What the map shows: areas with usable geometry, merged population and outer ring."""
    return _ring_figures(service(spark, d).block_groups(), "polygon", "geoid", "lat", "lon", "population")


# --- projections and filters -----------------------------------------------------------


@query("p1_county_filter")
def _(spark, d):
    return keys.keep_counties(areas(spark, d), ["189"]).select("geoid", "countyfp")


@query("p2_county_from_key")
def _(spark, d):
    return areas(spark, d).where(keys.county_of("geoid") == "189").select("geoid", keys.county_of("geoid").alias("county"))


@query("p3_affected_areas")
def _(spark, d):
    return demand(spark, d).select("geoid", "population")


@query("p4_site_type_filter")
def _(spark, d):
    return open_sites(spark, d).select("site_id", "type")


@query("p5_sites_by_type")
def _(spark, d):
    return open_sites(spark, d).groupBy("type").agg(F.count("*").alias("sites"))


@query("p6_project_cast")
def _(spark, d):
    return sites(spark, d).select(
        F.col("site_id").cast("string").alias("SITE_ID"), F.col("name").alias("NAME"), F.col("type").alias("TYPE"),
        F.col("lat").cast("double").alias("LAT"), F.col("lon").cast("double").alias("LON"),
    )


@query("p7_key_to_string")
def _(spark, d):
    numbers = areas(spark, d).select(F.col("geoid").cast("bigint").alias("geoid"))
    return area_ops.merge_population(numbers, [inputs.city_demographics(spark, d)])


@query("p8_existing_columns")
def _(spark, d):
    return demographics.existing_columns(inputs.estimate_counts(spark, d))


@query("p9_rename_map")
def _(spark, d):
    long = {short: name for name, short in census.LONG_NAMES.items()}
    source = inputs.counts(spark, d).select("geoid", *[F.col(short).alias(name) for short, name in long.items()])
    return census.rename_coded(source, census.LONG_NAMES)


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    return geometry.with_parts(areas(spark, d), "geom_geojson")


def _ring_figures(df: DataFrame, ring: str, *keep: str) -> DataFrame:
    """Scalars that pin a ring down: size, first vertex and sums."""
    return df.selectExpr(
        *keep,
        f"cast(size({ring}) AS bigint) AS vertices",
        f"{ring}[0][0] AS first_lon",
        f"{ring}[0][1] AS first_lat",
        f"round(aggregate({ring}, 0D, (s, v) -> s + v[0]), 6) AS sum_lon",
        f"round(aggregate({ring}, 0D, (s, v) -> s + v[1]), 6) AS sum_lat",
    )


@query("p10_usable_geometry")
def _(spark, d):
    ring = _parsed(spark, d).withColumn("ring", geometry.first_outer_ring("parts"))
    return ring.where(geometry.usable_ring("ring")).select("geoid", "population")


@query("p11_selected_flag")
def _(spark, d):
    return area_ops.flag_selected(areas(spark, d).select("geoid", "population"), inputs.affected(spark, d))


@query("p12_split_by_flag")
def _(spark, d):
    flagged = area_ops.flag_selected(areas(spark, d).select("geoid", "population"), inputs.affected(spark, d))
    layer = F.when(F.col("selected"), "selected").otherwise("base").alias("layer")
    return flagged.groupBy(layer).agg(F.count("*").alias("areas"), F.sum("population").alias("people"))


@query("p13_build_key")
def _(spark, d):
    return areas(spark, d).select(
        keys.build_geoid("statefp", "countyfp", "tractce").alias("tract"),
        keys.build_geoid("statefp", "countyfp", "tractce", "blkgrpce").alias("block_group"),
        keys.valid_geoid("geoid").alias("valid"),
    )


@query("p14_key_parts")
def _(spark, d):
    return keys.split_geoid(areas(spark, d).select("geoid"))


def _texts(spark: SparkSession, d: str) -> DataFrame:
    """Numbers as text, with words, decimals and nulls mixed in."""
    text = (
        "CASE WHEN population % 7 = 0 THEN 'none' WHEN population % 11 = 0 THEN NULL "
        "WHEN population % 5 = 0 THEN concat(cast(population AS string), '.5') ELSE cast(population AS string) END"
    )
    return areas(spark, d).selectExpr("geoid", f"{text} AS stated")


@query("p15_number_or_null")
def _(spark, d):
    return _texts(spark, d).select("geoid", F.expr(rates.number_or_null_sql("stated")).alias("value"))


@query("p16_number_or_zero")
def _(spark, d):
    return _texts(spark, d).select("geoid", F.expr(rates.number_or_zero_sql("stated", "double")).alias("value"))


@query("p17_fill_numbers")
def _(spark, d):
    return demographics.fill_numbers(inputs.county_demographics(spark, d))


@query("p18_location_text")
def _(spark, d):
    numbered = demographics.with_location(areas(spark, d), PLACE, "blkgrpce").withColumnRenamed("Location", "numbered")
    return demographics.with_location(numbered, PLACE).select("geoid", "numbered", F.col("Location").alias("location"))


# --- joins -----------------------------------------------------------------------------


def merged_areas(spark: SparkSession, d: str) -> DataFrame:
    boundaries = areas(spark, d).drop("population")
    sources = [inputs.county_demographics(spark, d), inputs.city_demographics(spark, d)]
    return area_ops.merge_population(boundaries, sources)


@query("j1_priority_merge")
def _(spark, d):
    return merged_areas(spark, d).select("geoid", "lat", "lon", "population")


@query("j2_enrich")
def _(spark, d):
    table = demographics.demographic_table(inputs.estimate_counts(spark, d), PLACE, "estimate")
    listed = table.where(F.col("POP") % 4 != 0).withColumnRenamed("GEOID", "geoid")
    return area_ops.enrich(areas(spark, d).select("geoid", "lat", "lon"), listed).select(
        "geoid", "lat", "lon", "POP", "Low_Income_Rate", "Total_Dependency_Rate"
    )


@query("j3_radius_join")
def _(spark, d):
    return rounded(radius_join(areas(spark, d), sites(spark, d), 2.0), "distance_miles")


@query("j3_radius_join_hot")
def _(spark, d):
    """The same pairs with every block of some size cut into parts on both sides."""
    return rounded(radius_join(areas(spark, d), sites(spark, d), 2.0, most_pairs=500), "distance_miles")


@query("j3_radius_join_copies")
def _(spark, d):
    """Some areas forty times over: classes of equal rows are tested once and repeated afterwards."""
    copies = F.when(F.col("population") % 5 == 0, 40).otherwise(1)
    heap = areas(spark, d).select("geoid", "lat", "lon", "population", F.explode(F.sequence(F.lit(1), copies)).alias("copy")).drop("copy")
    met = radius_join(heap, sites(spark, d), 1.0, most_pairs=2000, together=("geoid", "site_id"))
    # A pair of ids lies in one task, so no pair moves for its number.
    counted = met.groupBy("site_id", "geoid", *TOGETHER).agg(F.count("*").alias("rows"), F.round(F.max("distance_miles"), 6).alias("distance_miles"))
    return counted.drop(*TOGETHER)


@query("j4_not_selected")
def _(spark, d):
    run = flagship(spark, d)
    return area_ops.not_selected(open_sites(spark, d), run.sites).select("site_id", "name", "type")


@query("j5_covered_areas")
def _(spark, d):
    run = flagship(spark, d)
    return coverage.covered_areas(run.demand, run.selection).select("geoid", "population")


@query("j6_join_check")
def _(spark, d):
    every = quality.join_check(areas(spark, d), inputs.county_demographics(spark, d), county="189")
    few = quality.join_check(areas(spark, d), inputs.county_demographics(spark, d), county="189", sample=5)
    return every.withColumn("checked", F.lit("all")).unionAll(few.withColumn("checked", F.lit("sample")))


# --- aggregations ----------------------------------------------------------------------


@query("a1_total_population")
def _(spark, d):
    return demand(spark, d).agg(F.sum("population").alias("total_population"))


@query("a2_covered_population")
def _(spark, d):
    return flagship(spark, d).summary.select("covered_population")


@query("a3_coverage_percent")
def _(spark, d):
    return rounded(flagship(spark, d).summary.select("coverage_percent"), "coverage_percent")


@query("a4_remaining_gain")
def _(spark, d):
    """Gain of each site over the demand that the first pick leaves uncovered."""
    gains = coverage.remaining_gains(demand(spark, d), open_sites(spark, d), FLAGSHIP_RADIUS, 1)
    return gains.where("gain > 0").select("site_id", "gain")


@query("a5_best_gain")
def _(spark, d):
    reach = coverage.site_reach(demand(spark, d), open_sites(spark, d), FLAGSHIP_RADIUS)
    best = reach.where("reach_population > 0").orderBy(F.desc("reach_population"), "site_id").limit(1)
    return best.select("site_id", F.col("reach_population").alias("gain"))


@query("a6_row_count")
def _(spark, d):
    return areas(spark, d).agg(F.count("*").alias("block_groups"))


@query("a7_distinct_keys")
def _(spark, d):
    both = inputs.city_demographics(spark, d).unionAll(inputs.county_demographics(spark, d))
    return both.agg(F.count("*").alias("rows"), F.countDistinct("geoid").alias("keys"))


@query("a8_null_counts")
def _(spark, d):
    return quality.completeness_report(inputs.county_demographics(spark, d), "county").select("column_name", "null_count")


@query("a9_zero_counts")
def _(spark, d):
    report = quality.completeness_report(inputs.county_demographics(spark, d), "county", ["pop"])
    return report.select("column_name", "zero_count")


@query("a10_median")
def _(spark, d):
    return exact_median(inputs.counts(spark, d), "Median_HH_Income", "median_income")


@query("a10_medians")
def _(spark, d):
    """Medians of three columns, one of them with nulls, from two passes."""
    columns = {"median_income": "Median_HH_Income", "median_people": "POP", "median_households": "Total_Households"}
    return exact_medians(inputs.counts(spark, d), columns)


@query("a11_mean_rates")
def _(spark, d):
    table = demographics.demographic_table(inputs.estimate_counts(spark, d), PLACE, "estimate")
    means = table.agg(F.avg("Low_Income_Rate").alias("low_income"), F.avg("SNAP_Rate").alias("snap"))
    return rounded(means, "low_income", "snap")


@query("a12_view_center")
def _(spark, d):
    return rounded(reports.view_center(areas(spark, d)), "center_lat", "center_lon")


@query("a13_population_text")
def _(spark, d):
    total = areas(spark, d).agg(F.sum("population").alias("population"))
    return total.select("population", labels.count_text("population").alias("population_text"))


@query("a14_county_totals")
def _(spark, d):
    return reports.county_totals(areas(spark, d))


@query("a15_matched_rows")
def _(spark, d):
    check = quality.join_check(areas(spark, d), inputs.city_demographics(spark, d))
    return check.select("matched")


# --- sorts and limits ------------------------------------------------------------------


@query("t1_county_keys_sorted")
def _(spark, d):
    return keys.distinct_sorted_keys(areas(spark, d), county="189")


@query("t2_keys_sorted")
def _(spark, d):
    both = inputs.city_demographics(spark, d).unionAll(inputs.county_demographics(spark, d))
    return keys.distinct_sorted_keys(both)


@query("t3_limit")
def _(spark, d):
    return keys.first_keys(areas(spark, d).select("geoid", "population"), 5)


@query("t4_head_and_tail")
def _(spark, d):
    df = areas(spark, d).select("geoid", "population")
    head = keys.first_keys(df, 5).withColumn("part", F.lit("head"))
    return head.unionAll(keys.first_keys(df, 5, last=True).withColumn("part", F.lit("tail")))


@query("t5_top_gain_rounds")
def _(spark, d):
    chosen = coverage.greedy_cover(demand(spark, d), open_sites(spark, d), 2.0, 3).sites
    return chosen.select("rank", "site_id", "gain")


# --- set operations --------------------------------------------------------------------


@query("u1_union_first_wins")
def _(spark, d):
    return keys.union_first_wins([inputs.city_demographics(spark, d), inputs.county_demographics(spark, d)])


@query("u2_distinct")
def _(spark, d):
    return areas(spark, d).select("statefp", "countyfp").distinct()


@query("u3_key_sides")
def _(spark, d):
    return keys.key_sides(inputs.city_demographics(spark, d), inputs.county_demographics(spark, d))


@query("u4_append_sites")
def _(spark, d):
    points = sites(spark, d).select(F.col("site_id").cast("string").alias("site_id"), "lat", "lon")
    return points.unionByName(generate.base_sites(spark))


@query("u5_covered_keys")
def _(spark, d):
    run = flagship(spark, d)
    return coverage.covered_keys(run.demand, run.selection)


# --- demographic metrics ---------------------------------------------------------------

# Query name and output column.
METRICS = (
    ("m1_low_income_rate", "Low_Income_Rate"),
    ("m2_snap_rate", "SNAP_Rate"),
    ("m3_public_assistance_rate", "Public_Assistance_Rate"),
    ("m4_renter_rate", "Renter_Rate"),
    ("m5_vacancy_rate", "Vacancy_Rate"),
    ("m6_hh_with_children_rate", "HH_With_Children_Rate"),
    ("m7_single_parent_rate", "Single_Parent_Rate"),
    ("m8_no_car_rate", "No_Car_Rate"),
    ("m9_no_internet_rate", "No_Internet_Rate"),
    ("m10_children_0_17", "Children_0_17"),
    ("m11_children_0_4", "Children_0_4"),
    ("m12_children_5_17", "Children_5_17"),
    ("m13_child_dependency_rate", "Child_Dependency_Rate"),
    ("m14_elderly_65_74", "Elderly_65_74"),
    ("m15_elderly_75_plus", "Elderly_75_Plus"),
    ("m16_elderly_65_plus", "Elderly_65_Plus"),
    ("m17_elderly_dependency_rate", "Elderly_Dependency_Rate"),
    ("m18_total_dependency_rate", "Total_Dependency_Rate"),
    ("m19_built_before_1940", "Built_Before_1940"),
    ("m20_old_housing_rate", "Old_Housing_Rate"),
)
METRIC_MODES = ("cells", "estimate", "estimate_known_elderly")


def _metric_query(column: str) -> Query:
    def build(spark: SparkSession, d: str) -> DataFrame:
        frames = []
        for mode in METRIC_MODES:
            source = inputs.cell_counts(spark, d) if mode == "cells" else inputs.estimate_counts(spark, d)
            derived = demographics.derive_metrics(source, mode)
            frames.append(derived.select("GEOID", F.lit(mode).alias("mode"), F.col(column).alias("value")))
        return frames[0].unionAll(frames[1]).unionAll(frames[2])

    return build


for _name, _column in METRICS:
    query(_name)(_metric_query(_column))


@query("m21_rounding")
def _(spark, d):
    source = inputs.counts(spark, d).select(
        "geoid",
        F.expr("try_divide(Low_Income_HH, Total_Households) * 100").alias("Some_Rate"),
        F.expr("POP / 4D").alias("Quarter"),
    )
    return demographics.round_numbers(source)


@query("m_full_table")
def _(spark, d):
    return demographics.demographic_table(inputs.cell_counts(spark, d), PLACE, "cells")


# --- geometry, text --------------------------------------------------------------------


@query("geo1_haversine")
def _(spark, d):
    """Distance of each area to the anchor site it shares its last key digit with."""
    anchors = generate.base_sites(spark).selectExpr(
        "site_id", "lat AS a_lat", "lon AS a_lon", "row_number() OVER (ORDER BY site_id) - 1 AS slot"
    )
    slotted = areas(spark, d).withColumn("slot", F.expr("cast(geoid AS bigint) % 6"))
    miles = haversine_miles("a_lat", "a_lon", "lat", "lon")
    return slotted.join(F.broadcast(anchors), "slot").select("geoid", "site_id", F.round(miles, 6).alias("miles"))


@query("geo2_centroid")
def _(spark, d):
    df = geometry.with_centroid(_parsed(spark, d).select("geoid", "parts"), "parts").where("lat IS NOT NULL")
    return rounded(df.select("geoid", "lat", "lon"), "lat", "lon")


@query("geo3_projected_centroid")
def _(spark, d):
    df = geometry.with_projected_centroid(_parsed(spark, d).select("geoid", "parts"), "parts")
    return rounded(df.where("lat IS NOT NULL").select("geoid", "lat", "lon"), "lat", "lon", digits=7)


@query("geo4_first_outer_ring")
def _(spark, d):
    df = _parsed(spark, d).withColumn("ring", geometry.first_outer_ring("parts"))
    return _ring_figures(df.where(geometry.usable_ring("ring")), "ring", "geoid")


@query("geo5_polygon_parts")
def _(spark, d):
    parts = geometry.explode_parts(_parsed(spark, d), "parts", ["geoid", "population"])
    return _ring_figures(parts, "polygon", "geoid", "population")


@query("geo6_to_geojson")
def _(spark, d):
    return _parsed(spark, d).select("geoid", geometry.to_geojson("parts").alias("geojson")).where("geojson IS NOT NULL")


@query("geo7_parse_geojson")
def _(spark, d):
    return _parsed(spark, d).where("parts IS NOT NULL").selectExpr(
        "geoid", "cast(size(parts) AS bigint) AS parts", "cast(aggregate(parts, 0, (s, p) -> s + size(p)) AS bigint) AS rings"
    )


@query("str1_type_label")
def _(spark, d):
    return sites(spark, d).select("site_id", labels.type_label("type").alias("label"))


@query("str2_area_label")
def _(spark, d):
    return areas(spark, d).select("geoid", labels.area_label("geoid").alias("label"))


@query("str3_population_label")
def _(spark, d):
    df = areas(spark, d).withColumn("population", F.col("population") + 0.75)
    return df.select("geoid", labels.population_label("population").alias("label"))


@query("fmt1_number_texts")
def _(spark, d):
    return demographics.derive_metrics(inputs.estimate_counts(spark, d), "estimate").join(
        areas(spark, d).select(F.col("geoid").alias("GEOID"), "lat"), "GEOID"
    ).select(
        "GEOID", labels.count_text("Median_HH_Income").alias("income"), labels.percent_text("SNAP_Rate").alias("snap"),
        labels.coordinate_text("lat").alias("latitude"),
    )


@query("rnd1_lower_bound")
def _(spark, d):
    return areas(spark, d).select("geoid", F.greatest(F.lit(5000), F.col("population")).alias("at_least"))


# --- coverage --------------------------------------------------------------------------


@query("g1_greedy")
def _(spark, d):
    return flagship(spark, d).sites


def _picks(spark: SparkSession, d: str, radius: float, k: int, **options: int) -> DataFrame:
    chosen = coverage.greedy_cover(
        demand(spark, d), open_sites(spark, d), radius, k, options=coverage.SearchOptions(**options)
    )
    return chosen.sites.select("rank", "site_id", "gain", "cumulative_population")


@query("g1_greedy_rounds")
def _(spark, d):
    """One pick per round, past two checkpoints."""
    return _picks(spark, d, 2.0, 18, frontier_sites=1)


@query("g1_greedy_frontier")
def _(spark, d):
    """Frontiers smaller than the number of sites, so that sites outside compete."""
    return _picks(spark, d, 2.0, 10, frontier_sites=5)


@query("g1_greedy_cells")
def _(spark, d):
    return _picks(spark, d, FLAGSHIP_RADIUS, 3, leaf_points=8)


@query("g1_greedy_hot")
def _(spark, d):
    return _picks(spark, d, FLAGSHIP_RADIUS, 3, leaf_points=8, most_pairs=200)


@query("g2_repeated_keys")
def _(spark, d):
    """Keys shared by several areas: gains go by row, coverage by key."""
    tracts = demand(spark, d).withColumn("geoid", F.substring("geoid", 1, 11))
    selection = coverage.greedy_cover(tracts, open_sites(spark, d), 2.0, 3)
    return rounded(coverage.coverage_summary(tracts, selection), "coverage_percent")


@query("g2_run_summary")
def _(spark, d):
    return rounded(flagship(spark, d).summary, "coverage_percent")


@query("g3_covered_flag")
def _(spark, d):
    run = flagship(spark, d)
    return coverage.flag_covered(run.demand, run.selection).select("geoid", "population", "covered")


@query("g4_site_reach")
def _(spark, d):
    return coverage.site_reach(demand(spark, d), sites(spark, d), 2.0).select("site_id", "reach_population")


@query("g4_site_reach_cells")
def _(spark, d):
    options = coverage.SearchOptions(leaf_points=8, most_pairs=200)
    return coverage.site_reach(demand(spark, d), sites(spark, d), 2.0, options=options).select("site_id", "reach_population")


# --- generators, checks, reports -------------------------------------------------------


@query("gen1_scatter_sites")
def _(spark, d):
    ids = inputs.table(spark, d, "customer").select("c_custkey")
    return rounded(generate.scatter_sites(ids, "c_custkey"), "lat", "lon", digits=9)


@query("gen2_base_site_reach")
def _(spark, d):
    reach = coverage.site_reach(areas(spark, d), generate.base_sites(spark), 10.0)
    return reach.select("site_id", "reach_population")


@query("gen3_synthetic_demographics")
def _(spark, d):
    county = keys.distinct_sorted_keys(areas(spark, d), county="189")
    return generate.synthesize_demographics(county)


@query("q1_completeness")
def _(spark, d):
    demo = quality.completeness_report(inputs.county_demographics(spark, d), "county", distinct=["geoid"])
    bounds = quality.completeness_report(
        areas(spark, d), "boundaries", ["geoid", "population", "geom_geojson"], ["geoid"]
    )
    return demo.unionAll(bounds)


@query("q1_distinct_columns")
def _(spark, d):
    columns = ["geoid", "countyfp", "tractce", "population", "lat", "geom_geojson"]
    return quality.completeness_report(areas(spark, d), "boundaries", columns, columns[:5])


@query("q1_samples")
def _(spark, d):
    return quality.sample_values(inputs.county_demographics(spark, d), "geoid")


@query("q2_key_alignment")
def _(spark, d):
    return quality.key_alignment(areas(spark, d), inputs.county_demographics(spark, d))


@query("q2_alignment_verdict")
def _(spark, d):
    return quality.alignment_verdict(areas(spark, d), inputs.county_demographics(spark, d))


@query("q2_key_examples")
def _(spark, d):
    return quality.key_examples(areas(spark, d), inputs.city_demographics(spark, d))


@query("q3_join_verdict")
def _(spark, d):
    return quality.join_verdict(areas(spark, d), inputs.county_demographics(spark, d), county="189")


@query("r1_load_summary")
def _(spark, d):
    table = demographics.demographic_table(inputs.estimate_counts(spark, d), PLACE, "estimate")
    return rounded(reports.load_summary(table), "mean_low_income_rate", "mean_snap_rate")


@query("r2_affected_summary")
def _(spark, d):
    return reports.affected_summary(demand(spark, d))


@query("r3_results_table")
def _(spark, d):
    return reports.results_table(flagship(spark, d).sites)


@query("r3_metrics_text")
def _(spark, d):
    return reports.metrics_text(flagship(spark, d).summary)


@query("r4_area_features")
def _(spark, d):
    polygons = geometry.explode_parts(_parsed(spark, d), "parts", ["geoid", "population"])
    features = reports.area_features(polygons, inputs.affected(spark, d))
    return _ring_figures(features, "polygon", "geoid", "population", "selected", "name", "type_display")


@query("r4_demand_points")
def _(spark, d):
    return demand(spark, d).select("geoid", "lat", "lon")


@query("r4_site_features")
def _(spark, d):
    return reports.site_features(sites(spark, d), flagship(spark, d).sites)


@query("r4_features_json")
def _(spark, d):
    """Site features written as JSON, a folder per layer, and read back."""
    path = fresh_path(spark, "features")
    features = reports.site_features(sites(spark, d), flagship(spark, d).sites)
    reports.write_features(features, path, by="layer")
    return kept(spark, spark.read.schema(features.schema).json(path), path)


@query("r5_area_description")
def _(spark, d):
    derived = demographics.derive_metrics(inputs.estimate_counts(spark, d), "estimate")
    partly = derived.withColumn("SNAP_Rate", F.lit(None).cast("double")).withColumn(
        "Renter_Rate", F.expr("CASE WHEN POP % 5 > 0 THEN Renter_Rate END")
    )
    return reports.describe_areas(partly).select("GEOID", "description")


@query("r5_map_tables")
def _(spark, d):
    """Areas as the static map shows them: projected centroid, demographics and text."""
    table = demographics.demographic_table(inputs.estimate_counts(spark, d), PLACE, "estimate")
    shown = map_tables(areas(spark, d), table.where(F.col("POP") % 4 != 0))
    return rounded(shown.select("geoid", "lat", "lon", "POP", "description"), "lat", "lon", digits=7)
