"""Areas, sites and demographics derived from the benchmark tables.

``customer`` stands for census areas and ``supplier`` for candidate sites; keys
spread over a box around the two counties, with gaps, nulls and bad geometries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _degrees(tenthousandths: str, sign: str = "") -> str:
    """Text of a coordinate that is given in ten-thousandths of a degree."""
    whole = f"cast(cast(floor(({tenthousandths}) / 1e4D) AS bigint) AS string)"
    return f"concat('{sign}', {whole}, '.', lpad(cast(({tenthousandths}) % 10000 AS string), 4, '0'))"


def _ring(*corners: str) -> str:
    """Text of a ring through corners named by two letters, such as ``ws`` for west and south."""
    points = ", ".join(f"concat('[', {c[0]}, ',', {c[1]}, ']')" for c in corners)
    return f"concat('[', concat_ws(',', {points}), ']')"


def areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    square, triangle = _ring("ws", "es", "en", "wn", "ws"), _ring("ws", "es", "en", "ws")

    def shape(kind: str, coordinates: str) -> str:
        return f"""concat('{{"type":"{kind}","coordinates":', {coordinates}, '}}')"""

    geometry = (
        "CASE WHEN k % 41 = 0 THEN NULL WHEN k % 37 = 0 THEN 'not json' "
        f"WHEN k % 31 = 0 THEN {shape('Point', "concat('[', w, ',', s, ']')")} "
        f"WHEN k % 10 = 0 THEN {shape('MultiPolygon', f"concat('[[', {square}, '],[', {triangle}, ']]')")} "
        f"ELSE {shape('Polygon', f"concat('[', {square}, ']')")} END"
    )
    return (
        table(spark, sf_dir, "customer")
        .selectExpr(
            "c_custkey AS k",
            "CASE WHEN c_custkey % 10 < 3 THEN '510' ELSE '189' END AS countyfp",
            "384000 + (c_custkey * 7919) % 5000 AS la",
            "907400 - (c_custkey * 104729) % 6200 AS lo",
            "lpad(cast(c_custkey AS string), greatest(7, length(cast(c_custkey AS string))), '0') AS key",
            "cast(floor(abs(c_acctbal)) AS bigint) AS population",
        )
        .selectExpr(
            "*",
            f"{_degrees('lo + 20', '-')} AS w",
            f"{_degrees('lo - 20', '-')} AS e",
            f"{_degrees('la - 20')} AS s",
            f"{_degrees('la + 20')} AS n",
        )
        .selectExpr(
            "concat('29', countyfp, key) AS geoid",
            "'29' AS statefp",
            "countyfp",
            "substring(key, 1, 6) AS tractce",
            "substring(key, 7, 1) AS blkgrpce",
            "la / 1e4D AS lat",
            "-lo / 1e4D AS lon",
            "population",
            f"{geometry} AS geom_geojson",
        )
    )


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = "'school', 'place_of_worship', 'community_centre', 'fire_station', 'library', 'warehouse'"
    return table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey AS site_id",
        "s_name AS name",
        f"element_at(array({kinds}), cast(s_suppkey % 6 + 1 AS int)) AS type",
        "(384000 + (s_suppkey * 6007) % 5000) / 1e4D AS lat",
        "(-907400 + (s_suppkey * 15013) % 6200) / 1e4D AS lon",
    )


def city_demographics(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = areas(spark, sf_dir).where("countyfp = '510' OR population % 50 = 0")
    return listed.selectExpr("geoid", "population AS pop")


def county_demographics(spark: SparkSession, sf_dir: str) -> DataFrame:
    stated = "CASE WHEN population % 13 = 0 THEN NULL WHEN population % 17 = 0 THEN 0 ELSE population + 1 END"
    listed = areas(spark, sf_dir).where("countyfp = '189' AND population % 7 <> 0")
    return listed.selectExpr("geoid", f"cast({stated} AS bigint) AS pop")


# Count columns and the modulus each is derived with.
COUNT_MODULI = {
    "Low_Income_HH": 120,
    "HH_SNAP": 90,
    "Public_Assistance_HH": 60,
    "Total_Housing_Units": 600,
    "Renter_Occupied": 150,
    "Vacant_Housing_Units": 80,
    "Total_Workers": 700,
    "Workers_No_Car": 75,
    "HH_No_Internet": 65,
    "HH_With_Children": 110,
    "Single_Parent_HH": 45,
}


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return areas(spark, sf_dir).selectExpr(
        "geoid",
        "population AS POP",
        "CASE WHEN population % 97 = 0 THEN NULL ELSE population % 500 END AS Total_Households",
        *[f"population % {m} AS {name}" for name, m in COUNT_MODULI.items()],
        "population * 9 + 20000 AS Median_HH_Income",
        "population % 120 + 1900 AS Median_Year_Built",
    )


def affected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return areas(spark, sf_dir).where("population % 3 = 0").select("geoid")


# Age-sex cells and the modulus each is derived with.
AGE_MODULI = {
    "Female_0_4": 33, "Male_5_9": 31, "Female_5_9": 29, "Male_10_14": 27, "Female_10_14": 25, "Male_15_17": 23, "Female_15_17": 21,
    "Male_65_74": 41, "Female_65_74": 43, "Male_75_plus": 37, "Female_75_plus": 35,
}


def cell_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw counts with age-sex cells, some unknown, and housing age."""
    return (
        counts(spark, sf_dir)
        .withColumnRenamed("geoid", "GEOID")
        .selectExpr(
            "*",
            *[f"POP % {m} AS {name}" for name, m in AGE_MODULI.items() if name != "Male_5_9"],
            f"CASE WHEN POP % 11 <> 0 THEN POP % {AGE_MODULI['Male_5_9']} END AS Male_5_9",
            "POP % 333 AS Children_0_17",
            "CASE WHEN POP % 19 <> 0 THEN POP % 77 END AS Children_0_4",
            "POP % 50 AS Units_Before_1940",
            "POP % 400 AS Housing_Age_Universe",
        )
    )


def estimate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts(spark, sf_dir).withColumnRenamed("geoid", "GEOID").withColumn("Pop_65_Plus", F.expr("POP % 210"))


# Rows per response document, as many as one request asks for.
RESPONSE_ROWS = 50


def census_responses(spark: SparkSession, sf_dir: str, variables: dict[str, str]) -> DataFrame:
    """Response texts of at most RESPONSE_ROWS areas each, with some unreadable counts."""
    return _responses(spark, sf_dir, variables, "false").select("response")


def damaged_responses(spark: SparkSession, sf_dir: str, variables: dict[str, str]) -> DataFrame:
    """The same with some lines short of a field, and some responses cut off, empty, missing or errors."""
    return _responses(spark, sf_dir, variables, "POP % 23 = 0").selectExpr(
        "CASE (2 * chunk + if(county = '510', 1, 0)) % 9 WHEN 0 THEN substring(response, 1, length(response) - 2) "
        "WHEN 1 THEN concat(substring_index(response, ']', 1), ']]') WHEN 2 THEN NULL WHEN 3 THEN '[]' "
        """WHEN 4 THEN '{"error":"unknown variable"}' ELSE response END AS response"""
    )


def _responses(spark: SparkSession, sf_dir: str, variables: dict[str, str], short: str) -> DataFrame:
    codes = {"state": "substring(geoid, 1, 2)", "county": "substring(geoid, 3, 3)",
             "tract": "substring(geoid, 6, 6)", "block group": "substring(geoid, 12, 1)"}
    header = ", ".join(f"'{n}'" for n in ["NAME", *variables, *codes])
    fields = [f"cast({c} AS string)" for c in variables.values()]
    fields[1] = f"CASE WHEN POP % 71 = 0 THEN 'n/a' ELSE {fields[1]} END"
    line = ", ".join(["concat('Area ', geoid)", *fields, *codes.values()])
    return (
        cell_counts(spark, sf_dir).withColumnRenamed("GEOID", "geoid")
        .selectExpr("substring(geoid, 3, 3) AS county", f"cast(substring(geoid, 6) AS bigint) DIV {RESPONSE_ROWS} AS chunk",
                    f"slice(array({line}), 1, if({short}, {len(variables) + 4}, {len(variables) + 5})) AS line")
        .groupBy("county", "chunk")
        .agg(F.collect_list("line").alias("lines"))
        .selectExpr("county", "chunk", f"to_json(concat(array(array({header})), lines)) AS response")
    )
