from catchment.functions import labels
from catchment.operators import areas, keys, quality, reports

PAIR = "geoid string, pop bigint"


def frame(spark, rows, schema=PAIR):
    return spark.createDataFrame(rows, schema)


def test_priority_merge(spark):
    bounds = frame(spark, [("a",), ("b",), ("c",), ("d",)], "geoid string")
    county, city = frame(spark, [("a", 0), ("b", None), ("a2", 9)]), frame(spark, [("a", 5), ("b", 6), ("c", 7)])
    got = areas.merge_population(bounds, [county, city])
    assert {r.geoid: r.population for r in got.collect()} == {"a": 0, "b": 6, "c": 7, "d": 0}
    twice = areas.merge_population(bounds, [county, city.unionAll(city)])
    assert twice.where("geoid = 'c'").count() == 2


def test_keys_by_list_and_table(spark):
    df = frame(spark, [("a", 1), ("b", 2), ("c", 3)])
    assert {r.geoid for r in areas.keep_keys(df, ["a", "c", "z"]).collect()} == {"a", "c"}
    long = ["a", "c"] + [f"k{i}" for i in range(1500)]
    assert {r.geoid for r in areas.keep_keys(df, long).collect()} == {"a", "c"}
    assert {r.geoid for r in areas.keep_keys(df, frame(spark, [("b", 0), ("b", 0)])).collect()} == {"b"}
    flagged = areas.flag_selected(df, frame(spark, [("b", 0), ("b", 0)]))
    assert {r.geoid: r.selected for r in flagged.collect()} == {"a": False, "b": True, "c": False}


def test_geoid_parts(spark):
    row = keys.split_geoid(frame(spark, [("291890201021", 1)])).select(
        "*", keys.valid_geoid("geoid").alias("ok"), keys.county_of("geoid").alias("county")).first()
    assert (row.statefp, row.countyfp, row.tractce, row.blkgrpce, row.ok, row.county) == ("29", "189", "020102", "1", True, "189")
    bad = frame(spark, [("29189000001", 1), (None, 1), ("29189020102x", 1)])
    assert [r.ok for r in bad.select(keys.valid_geoid("geoid").alias("ok")).collect()] == [False] * 3


def test_first_source_wins(spark):
    got = keys.union_first_wins([frame(spark, [("a", 1), ("a", 0)]), frame(spark, [("a", 2), ("b", 3)])])
    assert sorted(tuple(r) for r in got.collect()) == [("a", 0), ("b", 3)]


def test_key_alignment(spark):
    left, right = frame(spark, [("a", 1), ("a", 1), ("b", 1), (None, 1)]), frame(spark, [("b", 1), ("c", 1)])
    assert {r.side: r["keys"] for r in quality.key_alignment(left, right).collect()} == {
        "both": 1, "left_only": 1, "right_only": 1}
    assert {r.side: r["keys"] for r in quality.key_alignment(left, left).collect()} == {
        "both": 2, "left_only": 0, "right_only": 0}
    assert sorted(tuple(r) for r in quality.key_examples(left, right).collect()) == [("a", "left_only"), ("c", "right_only")]
    assert "lack" in quality.alignment_verdict(left, right).first().verdict
    assert "lack" not in quality.alignment_verdict(left, left).first().verdict


def test_completeness(spark):
    df = frame(spark, [("a", 0), ("a", None), (None, 3)])
    lines = {r.column_name: r for r in quality.completeness_report(df, "t", distinct=["geoid"]).collect()}
    assert (lines["geoid"].row_count, lines["geoid"].distinct_count, lines["geoid"].null_count, lines["geoid"].zero_count) == (3, 1, 1, None)
    assert (lines["pop"].null_count, lines["pop"].zero_count, lines["pop"].data_type) == (1, 1, "bigint")


def test_join_check(spark):
    left, right = frame(spark, [("29189", 1), ("29510", 1), ("29189x", 1)]), frame(spark, [("29189", 1)])
    assert tuple(quality.join_check(left, right, county="189").first()) == (2, 1)
    assert quality.join_verdict(left, right, county="189", sample=1).first().verdict == "all keys match"
    assert quality.join_verdict(left, right, county="189").first().verdict == "some keys do not match"


def test_labels(spark):
    df = frame(spark, [("place_of_worship", 1234567)], "type string, n bigint")
    row = df.select(labels.type_label("type").alias("t"), labels.count_text("n").alias("n"),
                    labels.percent_text("n").alias("p"), labels.population_label("n").alias("l")).first()
    assert tuple(row) == ("Place Of Worship", "1,234,567", "1234567.0%", "Census Block Group (Pop: 1234567)")
    share = frame(spark, [(0.125,)], "v double").select(labels.percent_text("v", "fraction")).first()[0]
    assert share == "12.5%"


def test_descriptions_hold_known_fields_only(spark):
    df = frame(spark, [("1", 1200, None, 5.25), (None, None, "P", None)], "GEOID string, POP bigint, Location string, Renter_Rate double")
    assert [r.description for r in reports.describe_areas(df).collect()] == [
        "GEOID: 1; POP: 1,200; Renter_Rate: 5.2%", "GEOID: N/A; Location: P"]


def test_features_are_written_per_layer(spark, tmp_path):
    schema = "site_id string, name string, type string, lat double, lon double"
    sites = frame(spark, [("1", "A", "school", 1.0, 2.0), ("2", "B", "library", 1.0, 2.0), ("3", "C", "warehouse", 0.0, 0.0)], schema)
    features = reports.site_features(sites, sites.where("site_id = '2'"))
    reports.write_features(features, str(tmp_path / "f"), by="layer")
    back = spark.read.json(str(tmp_path / "f"))
    assert sorted((r.layer, r.site_id) for r in back.collect()) == [("school", "1"), ("selected", "2")]


def test_distinct_columns_repeat_no_rows(spark):
    from catchment.operators.quality import completeness_report

    df = spark.range(100).selectExpr("id", "id % 7 AS a", "if(id % 5 = 0, NULL, id % 11) AS b", "'x' AS c", "cast(NULL AS int) AS d")
    report = completeness_report(df, "t", distinct=["id", "a", "b", "c", "d"])
    assert "Expand" not in report._jdf.queryExecution().executedPlan().toString()
    assert {r.column_name: (r.distinct_count, r.null_count) for r in report.collect()} == {
        "id": (100, 0), "a": (7, 0), "b": (11, 20), "c": (1, 0), "d": (0, 100)}
