import json
import os

import pytest

from catchment import schemas
from catchment.session import fresh_path, shared_folder
from catchment.sources import census, tables
from catchment.sources.cache import FrameCache


def test_csv_keeps_leading_zeros_quotes_and_gaps(spark):
    path = fresh_path(spark, "csv")
    rows = [("010010201001", "29", "001", "020100", "1", 1.5, -2.5, '{"type":"Polygon"}'), ("2", *[None] * 7)]
    tables.write_csv(spark.createDataFrame(rows, schemas.BOUNDARIES), path)
    assert [tuple(r) for r in tables.read_boundaries_csv(spark, path).orderBy("GEOID").collect()] == rows


def test_csv_written_elsewhere(spark, tmp_path):
    path = tmp_path / "sites.csv"
    path.write_text('site_id,lat,lon\n"a ""b""",38.5,-90\nc,,\n')
    assert [tuple(r) for r in tables.read_candidates_csv(spark, str(path)).collect()] == [
        ('a "b"', 38.5, -90.0), ("c", None, None)]


def test_tables_replace_and_append(spark):
    df = spark.createDataFrame([("a", 1)], "geoid string, pop bigint")
    for mode, rows in (("overwrite", 1), ("append", 2), ("overwrite", 1)):
        tables.write_table(df, "replace_me", mode)
        assert tables.read_table(spark, "replace_me").count() == rows
    assert tables.run_sql(spark, "SELECT sum(pop) AS s FROM {t}", t=df).first().s == 1


def test_load_files_skips_what_is_not_there(spark, tmp_path):
    (tmp_path / "sites.csv").write_text("site_id,lat,lon\na,1,2\nb,3,4\n")
    entries = {
        "loaded_sites": (str(tmp_path / "sites.csv"), schemas.CANDIDATE_POINTS),
        "no_sites": (str(tmp_path / "none.csv"), schemas.CANDIDATE_POINTS),
    }
    report = {r.table_name: (r.status, r.row_count, r.rejected_count) for r in tables.load_files(spark, entries).collect()}
    assert report == {"loaded_sites": ("loaded", 2, 0), "no_sites": ("skipped", None, None)}
    assert spark.table("loaded_sites").count() == 2


def test_lines_that_do_not_fit_are_kept_apart(spark, tmp_path):
    (tmp_path / "mixed.csv").write_text('site_id,lat,lon\na,1,2\nb,north,4\nc,,\nd,5\ne,1,2,3\n"f,1","7",8\n')
    entries = {"mixed_sites": (str(tmp_path / "mixed.csv"), schemas.CANDIDATE_POINTS)}
    report = tables.load_files(spark, entries).first()
    assert (report.row_count, report.rejected_count) == (3, 3)
    assert sorted(tuple(r) for r in spark.table("mixed_sites").collect()) == [("a", 1.0, 2.0), ("c", None, None), ("f,1", 7.0, 8.0)]
    assert sorted(r.line for r in spark.table("mixed_sites_rejected").collect()) == ["b,north,4", "d,5", "e,1,2,3"]


def test_equal_buckets_are_joined_in_place(spark):
    from catchment.operators.areas import merge_population

    for name, value in (("bucket_areas", "lat"), ("bucket_city", "pop"), ("bucket_county", "pop")):
        df = spark.range(500).selectExpr("cast(id AS string) AS geoid", f"id AS {value}")
        tables.write_table(df, name, buckets=("geoid", 4))
    stored = [tables.read_table(spark, n) for n in ("bucket_areas", "bucket_county", "bucket_city")]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        merged = merge_population(stored[0], stored[1:])
        assert merged.where("population = lat").count() == 500
        plan = merged._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("SortMergeJoin") == 2 and "Exchange" not in plan


def test_rejects_account_for_everything_received(spark):
    good = json.dumps([["state", "county", "tract", "block group", "V"], *[["29", "189", "000100", str(i), "1"] for i in range(5)]])
    short = json.dumps([["state", "county", "tract", "block group", "V"], ["29", "189", "000100", "1", "1"], ["29"], None, ["29", "189", "000100", "1", "1", "2"]])
    texts = [good, short, None, "", "no json", "{}", "[1, 2]", "[]", "[[]]", "[null]", '[["state"]]', good[:-1]]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, response string")
    assert census.decode_block_groups(df, variables={"V": "v"}).count() == 6
    got = sorted((r.id, r.line or 0, r.reason) for r in census.response_rejects(df, "response", ["id"]).collect())
    assert got == [
        (1, 2, "fields differ from header"), (1, 3, "fields differ from header"), (1, 4, "fields differ from header"),
        (2, 0, "no response"), (3, 0, "no array of rows"), (4, 0, "no array of rows"), (5, 0, "no array of rows"),
        (6, 0, "no array of rows"), (7, 0, "no header"), (8, 0, "no header"), (9, 0, "no header"), (10, 0, "no data row"),
        (11, 0, "no array of rows"),
    ]


def test_response_fields_are_found_by_name(spark):
    header = ["NAME", "B11001_001E", "B01003_001E", "block group", "tract", "county", "state"]
    body = [["x", "7", "100", "1", "020100", "189", "29"], ["y", None, "abc", "2", "020100", "189", "29"]]
    texts = [json.dumps([header, *body]), json.dumps([header]), "[]", "no json"]
    df = spark.createDataFrame([(t,) for t in texts], "response string")
    got = census.decode_block_groups(df, variables={"B01003_001E": "POP", "B11001_001E": "HH", "B99": "Missing"})
    assert sorted(tuple(r) for r in got.collect()) == [("291890201001", 100, 7, 0), ("291890201002", 0, 0, 0)]


def test_tract_population_that_is_no_number_is_null(spark):
    text = json.dumps([["NAME", "B01001_001E", "state", "county", "tract"], ["a", "5", "29", "510", "000100"],
                       ["b", "-", "29", "510", "000200"]])
    rows = census.decode_tracts(spark.createDataFrame([(text,)], "response string")).collect()
    assert [tuple(r) for r in rows] == [("29510000100", "a", 5.0), ("29510000200", "b", None)]


def test_cache_builds_once_and_releases(spark):
    built = []
    with FrameCache() as cache:
        for _ in range(2):
            frame = cache.get("x", lambda: built.append(1) or spark.range(3))
        assert frame.count() == 3 and len(built) == 1 and frame.is_cached
        cache.get("y", lambda: spark.range(4))
        cache.drop_all_but("y")
        assert not frame.is_cached
    cache.clear()


def test_shared_folder_is_the_one_the_session_names(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    assert os.path.dirname(fresh_path(spark, "a")) == shared_folder(spark)
    assert fresh_path(spark, "a") != fresh_path(spark, "a")


@pytest.mark.parametrize("name", ["BOUNDARIES", "DEMOGRAPHICS", "CANDIDATE_SITES", "DATA_DICTIONARY"])
def test_schemas_are_readable(spark, name):
    assert spark.createDataFrame([], getattr(schemas, name)).count() == 0


def test_service_keeps_and_releases_frames(spark):
    from catchment.plans.service import CoverageService

    square = '{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]}'
    bounds = spark.createDataFrame(
        [("a", 38.6, -90.2, square), ("b", 38.6, -90.2, None)], "geoid string, lat double, lon double, geom_geojson string")
    city = spark.createDataFrame([("a", 5), ("b", 6)], "geoid string, pop bigint")
    county = spark.createDataFrame([("b", 7)], "geoid string, pop bigint")
    sites = spark.createDataFrame([("s", "S", "school", 38.6, -90.2)], "site_id string, name string, type string, lat double, lon double")
    for strict, total in ((False, 12), (True, 5)):
        shared = CoverageService(bounds, city, county, sites, require_geometry=strict)
        run = shared.optimize(["a", "b"])
        assert tuple(run.summary.first()) == (total, total, 100.0, 1)
        assert [r.geoid for r in shared.block_groups().collect()] == ["a"]
        assert shared.candidates().is_cached
        shared.clear_cache()
        assert not run.demand.is_cached and shared._cache._frames == {}
