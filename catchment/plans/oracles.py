"""SQL equivalents of the registered queries, for an engine other than Spark.

Each text stands alone: it starts with the derived inputs as common table
expressions and computes the result in its own way, with brute-force distances,
unrolled greedy rounds and row-wise geometry.
"""

from __future__ import annotations

import math

from catchment.schemas import DEMOGRAPHIC_COLUMNS

# Written out here and not shared with the code they check (fixed values).
GRS80_A = 6378137.0
UTM_SCALE = 0.9996
UTM_FALSE_EASTING = 500000.0
UTM_MERIDIAN = -93.0
_E2 = 0.006694380022900787
_EP2 = 0.006739496775478957
_ARC = 0.9983242984445848
_ARC_TERMS = [(-0.0025146070728448195, 2), (2.6390466202308984e-06, 4), (-3.4180461367752136e-09, 6)]
_FOOT_TERMS = [(0.0025188265967581876, 2), (3.7009490719640127e-06, 4), (7.447813877211132e-09, 6), (1.7035993573185927e-11, 8)]
BASE_SITES = (('church_1', 38.6359, -90.2211), ('church_2', 38.6277, -90.1994), ('school_1', 38.646, -90.2547),
 ('school_2', 38.6089, -90.2368), ('community_1', 38.6701, -90.2846), ('community_2', 38.5964, -90.2253))
CONSTANT_RATES = {'Low_Income_Rate': 9.7,
 'SNAP_Rate': 6.5,
 'Public_Assistance_Rate': 2.0,
 'Child_Dependency_Rate': 18.0,
 'Elderly_Dependency_Rate': 17.0,
 'Total_Dependency_Rate': 35.0,
 'HH_With_Children_Rate': 28.0,
 'Single_Parent_Rate': 8.0,
 'Renter_Rate': 31.0,
 'Vacancy_Rate': 8.0,
 'Old_Housing_Rate': 0.0,
 'No_Car_Rate': 8.0,
 'No_Internet_Rate': 4.0}
HOUSEHOLD_SHARES = {'Low_Income_HH': 0.097,
 'HH_SNAP': 0.065,
 'Public_Assistance_HH': 0.02,
 'HH_With_Children': 0.28,
 'Single_Parent_HH': 0.08,
 'Renter_Occupied': 0.31,
 'Vacant_Housing_Units': 0.08,
 'HH_No_Internet': 0.04}
PEOPLE_SHARES = {'Children_0_17': 0.18,
 'Children_0_4': 0.045,
 'Children_5_17': 0.135,
 'Elderly_65_Plus': 0.17,
 'Elderly_65_74': 0.1,
 'Elderly_75_Plus': 0.07,
 'Total_Workers': 0.4}
COUNT_MODULI = {'Low_Income_HH': 120,
 'HH_SNAP': 90,
 'Public_Assistance_HH': 60,
 'Total_Housing_Units': 600,
 'Renter_Occupied': 150,
 'Vacant_Housing_Units': 80,
 'Total_Workers': 700,
 'Workers_No_Car': 75,
 'HH_No_Internet': 65,
 'HH_With_Children': 110,
 'Single_Parent_HH': 45}
AGE_MODULI = {'Female_0_4': 33,
 'Male_5_9': 31,
 'Female_5_9': 29,
 'Male_10_14': 27,
 'Female_10_14': 25,
 'Male_15_17': 23,
 'Female_15_17': 21,
 'Male_65_74': 41,
 'Female_65_74': 43,
 'Male_75_plus': 37,
 'Female_75_plus': 35}
ACS_NAMES = ('POP', 'Total_Households', 'Median_HH_Income', 'Low_Income_HH', 'HH_SNAP', 'Public_Assistance_HH',
 'Total_Housing_Units', 'Renter_Occupied', 'Vacant_Housing_Units', 'Total_Workers', 'Workers_No_Car',
 'HH_No_Internet', 'HH_With_Children', 'Single_Parent_HH')
ACS_CELL_NAMES = ('POP', 'Total_Households', 'Median_HH_Income', 'Low_Income_HH', 'HH_SNAP', 'Children_0_17', 'Children_0_4',
 'Female_0_4', 'Male_5_9', 'Female_5_9', 'Male_10_14', 'Female_10_14', 'Male_15_17', 'Female_15_17', 'Male_65_74',
 'Female_65_74', 'Male_75_plus', 'Female_75_plus', 'HH_With_Children', 'Single_Parent_HH', 'Renter_Occupied',
 'Total_Housing_Units', 'Vacant_Housing_Units', 'Median_Year_Built', 'Total_Workers', 'Workers_No_Car',
 'HH_No_Internet', 'Public_Assistance_HH')
LONG_NAMES = ('Low_Income_HH', 'HH_SNAP', 'Public_Assistance_HH', 'HH_With_Children', 'Single_Parent_HH', 'Total_Workers',
 'Workers_No_Car', 'HH_No_Internet')

R = 3958.7613

FX = """
WITH fx_areas_base AS (
  SELECT c_custkey AS k,
         CASE WHEN c_custkey % 10 < 3 THEN '510' ELSE '189' END AS countyfp,
         384000 + (c_custkey * 7919) % 5000 AS la,
         907400 - (c_custkey * 104729) % 6200 AS lo,
         CAST(floor(abs(c_acctbal)) AS BIGINT) AS pop
  FROM customer),
fx_areas_str AS (
  SELECT k, countyfp, la, lo, pop,
    concat('-', CAST(CAST(floor((lo + 20) / 1e4) AS BIGINT) AS VARCHAR), '.', lpad(CAST((lo + 20) % 10000 AS VARCHAR), 4, '0')) AS w,
    concat('-', CAST(CAST(floor((lo - 20) / 1e4) AS BIGINT) AS VARCHAR), '.', lpad(CAST((lo - 20) % 10000 AS VARCHAR), 4, '0')) AS e,
    concat(CAST(CAST(floor((la - 20) / 1e4) AS BIGINT) AS VARCHAR), '.', lpad(CAST((la - 20) % 10000 AS VARCHAR), 4, '0')) AS s,
    concat(CAST(CAST(floor((la + 20) / 1e4) AS BIGINT) AS VARCHAR), '.', lpad(CAST((la + 20) % 10000 AS VARCHAR), 4, '0')) AS n
  FROM fx_areas_base),
fx_areas AS (
  SELECT concat('29', countyfp, lpad(CAST(k AS VARCHAR), 7, '0')) AS geoid,
    '29' AS statefp, countyfp,
    substring(lpad(CAST(k AS VARCHAR), 7, '0'), 1, 6) AS tractce,
    substring(lpad(CAST(k AS VARCHAR), 7, '0'), 7, 1) AS blkgrpce,
    CAST(la AS DOUBLE) / 10000 AS lat, -CAST(lo AS DOUBLE) / 10000 AS lon, pop AS population,
    CASE WHEN k % 41 = 0 THEN NULL
      WHEN k % 37 = 0 THEN 'not json'
      WHEN k % 31 = 0 THEN concat('{"type":"Point","coordinates":[', w, ',', s, ']}')
      WHEN k % 10 = 0 THEN concat('{"type":"MultiPolygon","coordinates":[[[[', w, ',', s, '],[', e, ',', s, '],[', e, ',', n, '],[', w, ',', n, '],[', w, ',', s, ']]],[[[', w, ',', s, '],[', e, ',', s, '],[', e, ',', n, '],[', w, ',', s, ']]]]}')
      ELSE concat('{"type":"Polygon","coordinates":[[[', w, ',', s, '],[', e, ',', s, '],[', e, ',', n, '],[', w, ',', n, '],[', w, ',', s, ']]]}')
    END AS geom_geojson
  FROM fx_areas_str),
fx_sites AS (
  SELECT s_suppkey AS site_id, s_name AS name,
    CASE s_suppkey % 6 WHEN 0 THEN 'school' WHEN 1 THEN 'place_of_worship' WHEN 2 THEN 'community_centre'
      WHEN 3 THEN 'fire_station' WHEN 4 THEN 'library' ELSE 'warehouse' END AS type,
    CAST(384000 + (s_suppkey * 6007) % 5000 AS DOUBLE) / 10000 AS lat,
    CAST(-907400 + (s_suppkey * 15013) % 6200 AS DOUBLE) / 10000 AS lon
  FROM supplier),
fx_open AS (SELECT * FROM fx_sites WHERE type <> 'warehouse'),
fx_demo_city AS (
  SELECT geoid, population AS pop FROM fx_areas WHERE countyfp = '510' OR population % 50 = 0),
fx_demo_county AS (
  SELECT geoid, CASE WHEN population % 13 = 0 THEN NULL WHEN population % 17 = 0 THEN 0 ELSE population + 1 END AS pop
  FROM fx_areas WHERE countyfp = '189' AND population % 7 <> 0),
fx_affected AS (SELECT geoid FROM fx_areas WHERE population % 3 = 0),
fx_demand AS (SELECT * FROM fx_areas WHERE geoid IN (SELECT geoid FROM fx_affected)),
""" + f"""
fx_counts AS (
  SELECT geoid, population AS POP, CASE WHEN population % 97 = 0 THEN NULL ELSE population % 500 END AS Total_Households,
    {", ".join(f"population % {m} AS {n}" for n, m in COUNT_MODULI.items())},
    20000 + population * 9 AS Median_HH_Income, 1900 + population % 120 AS Median_Year_Built, population % 210 AS Pop_65_Plus
  FROM fx_areas)
"""

ORACLES: dict[str, str] = {}


def oracle(name: str, body: str, *extra: str) -> None:
    """Registers a body; ``extra`` are further table expressions it uses."""
    ORACLES[name] = ",\n".join([FX.rstrip(), *extra]) + "\n" + body


def miles(a: str, b: str) -> str:
    return (
        f"{2 * R!r} * asin(sqrt(least(1.0, sin(radians({b}.lat - {a}.lat) / 2) ** 2 "
        f"+ cos(radians({a}.lat)) * cos(radians({b}.lat)) * sin(radians({b}.lon - {a}.lon) / 2) ** 2)))"
    )


def pairs(demand: str, sites: str, radius: float, name: str = "pairs") -> str:
    return (
        f"{name} AS MATERIALIZED (SELECT s.site_id, d.geoid, d.population, {miles('s', 'd')} AS miles "
        f"FROM {sites} s, {demand} d WHERE {miles('s', 'd')} <= {radius!r})"
    )


def greedy(k: int, radius: float, demand: str = "fx_demand", tag: str = "") -> list[str]:
    """Pairs and one materialised step per pick: p1 .. pk (site_id, gain, rank) and c1 .. ck (geoid)."""
    steps = [pairs(demand, "fx_open", radius, f"pairs{tag}")]
    rounds = range(1, k + 1)
    for i in rounds:
        taken = " AND ".join(f"geoid NOT IN (SELECT geoid FROM c{j}{tag})" for j in range(1, i)) or "TRUE"
        steps.append(
            f"p{i}{tag} AS MATERIALIZED (SELECT site_id, CAST(sum(population) AS BIGINT) AS gain, {i} AS rank "
            f"FROM pairs{tag} WHERE {taken} GROUP BY site_id HAVING sum(population) > 0 ORDER BY gain DESC, site_id LIMIT 1)"
        )
        steps.append(
            f"c{i}{tag} AS MATERIALIZED (SELECT DISTINCT geoid FROM pairs{tag} "
            f"WHERE site_id IN (SELECT site_id FROM p{i}{tag}))"
        )
    steps.append(f"picks{tag} AS (" + " UNION ALL ".join(f"SELECT * FROM p{i}{tag}" for i in rounds) + ")")
    steps.append(f"covered{tag} AS (" + " UNION ".join(f"SELECT geoid FROM c{i}{tag}" for i in rounds) + ")")
    return steps


MERGED = """fx_merged AS (SELECT b.geoid, b.lat, b.lon, coalesce(y.pop, c.pop, 0) AS population FROM fx_areas b
LEFT JOIN fx_demo_city c ON b.geoid = c.geoid LEFT JOIN fx_demo_county y ON b.geoid = y.geoid),
fx_merged_demand AS (SELECT * FROM fx_merged WHERE geoid IN (SELECT geoid FROM fx_affected))"""
FLAG = greedy(5, 5.0)


def half_even(value: str, digits: int = 2) -> str:
    return f"round_even(({value}) * {10.0**digits!r}::DOUBLE, 0) / {10.0**digits!r}::DOUBLE"


def rate(n: str, d: str) -> str:
    return f"coalesce({n}::DOUBLE / nullif({d}, 0)::DOUBLE * 100, 0)"


def trunc(value: str) -> str:
    return f"CAST(trunc({value}) AS BIGINT)"


# --- sources, sinks, cache ---

ORACLES["src1_table_scan"] = "SELECT * FROM customer"
oracle("src2_named_accessors", """SELECT 'sites' AS source, CAST(site_id AS VARCHAR) AS "key" FROM fx_sites
UNION ALL SELECT 'demographics', geoid FROM fx_demo_city UNION ALL SELECT 'boundaries', geoid FROM fx_areas""")
oracle("src3_run_sql", "SELECT geoid, population FROM fx_areas WHERE countyfp = '189'")
oracle("src4_csv_read", "SELECT geoid, statefp, countyfp, tractce, blkgrpce, lat, lon, geom_geojson FROM fx_areas")
oracle("src5_load_files", """SELECT 'candidates' AS table_name, 'loaded' AS status, count(*) AS row_count FROM fx_open
UNION ALL SELECT 'absent', 'skipped', NULL""")
_decoded = ", ".join(
    f"coalesce({n}, 0) AS {n}" if n != "Total_Households"
    else "CASE WHEN POP % 71 = 0 THEN 0 ELSE coalesce(Total_Households, 0) END AS Total_Households"
    for n in ACS_NAMES
)
oracle("src6_census_decode", f"SELECT geoid AS GEOID, {_decoded} FROM fx_counts")
oracle("src6_tract_decode", """SELECT substring(geoid, 1, 11) AS GEOID, concat('Area ', geoid) AS NAME,
CAST(CASE WHEN POP % 71 = 0 THEN NULL ELSE POP END AS DOUBLE) AS POP FROM fx_counts""")
oracle("src5_load_rejects", """SELECT 'loaded' AS status, count(*) FILTER (site_id % 7 <> 0) AS row_count, count(*) FILTER (site_id % 7 = 0) AS rejected_count,
count(*) FILTER (site_id % 7 <> 0) AS stored_rows, round(sum(lat) FILTER (site_id % 7 <> 0), 6) AS stored_lat,
count(*) FILTER (site_id % 7 = 0) AS stored_lines FROM fx_sites""")
oracle("src6_census_rejects", """SELECT CASE place WHEN 1 THEN 'no data row' WHEN 2 THEN 'no response' WHEN 3 THEN 'no header'
ELSE 'no array of rows' END AS reason, count(DISTINCT number) AS rows FROM numbered WHERE place < 5 GROUP BY 1
UNION ALL SELECT CASE WHEN POP % 23 = 0 THEN 'fields differ from header' ELSE 'decoded' END, count(*) FROM numbered WHERE place >= 5 GROUP BY 1""",
"""numbered AS (SELECT *, number % 9 AS place FROM (SELECT *, 2 * (CAST(substring(geoid, 6) AS BIGINT) // 50)
+ CASE WHEN substring(geoid, 3, 3) = '510' THEN 1 ELSE 0 END AS number FROM fx_counts))""")
oracle("src7_rename_coded", f"SELECT geoid, {', '.join(ACS_NAMES)} FROM fx_counts")
oracle("snk1_table_replace", "SELECT * FROM fx_demo_city")
oracle("snk1_bucketed_merge", """SELECT b.geoid, b.lat, b.lon, coalesce(y.pop, c.pop, 0) AS population FROM fx_areas b
LEFT JOIN fx_demo_city c ON b.geoid = c.geoid LEFT JOIN fx_demo_county y ON b.geoid = y.geoid""")
oracle("snk2_table_append", "SELECT * FROM fx_demo_city UNION ALL SELECT * FROM fx_demo_county")
oracle("snk3_csv_write", f"""SELECT geoid AS GEOID, 'Block Group, St. Louis County, Missouri' AS Location, POP,
{half_even(rate('HH_SNAP', 'Total_Households'))} AS SNAP_Rate,
{half_even(rate('HH_No_Internet', 'Total_Households'))} AS No_Internet_Rate FROM fx_counts""")
oracle("cache1_shared_frames", " UNION ALL ".join(f"""SELECT {r!r}::DOUBLE AS radius_miles,
CAST((SELECT sum(population) FROM fx_merged_demand) AS BIGINT) AS total_population,
CAST((SELECT sum(population) FROM fx_merged_demand WHERE geoid IN (SELECT geoid FROM covered{t})) AS BIGINT) AS covered_population,
round(100.0 * (SELECT sum(population) FROM fx_merged_demand WHERE geoid IN (SELECT geoid FROM covered{t}))::DOUBLE
/ (SELECT sum(population) FROM fx_merged_demand)::DOUBLE, 6) AS coverage_percent,
CAST((SELECT count(*) FROM picks{t}) AS INTEGER) AS selected_count""" for r, t in ((2.0, "_near"), (5.0, "_far"))),
    MERGED, *greedy(3, 2.0, "fx_merged_demand", "_near"), *greedy(3, 5.0, "fx_merged_demand", "_far"))

# --- projections and filters ---

oracle("p1_county_filter", "SELECT geoid, countyfp FROM fx_areas WHERE countyfp = '189'")
oracle("p2_county_from_key", "SELECT geoid, substring(geoid, 3, 3) AS county FROM fx_areas WHERE substring(geoid, 3, 3) = '189'")
oracle("p3_affected_areas", "SELECT geoid, population FROM fx_demand")
oracle("p4_site_type_filter", "SELECT site_id, type FROM fx_open")
oracle("p5_sites_by_type", "SELECT type, count(*) AS sites FROM fx_open GROUP BY type")
oracle("p6_project_cast", """SELECT CAST(site_id AS VARCHAR) AS SITE_ID, name AS NAME, type AS TYPE, lat AS LAT, lon AS LON
FROM fx_sites""")
oracle("p7_key_to_string", """SELECT CAST(CAST(a.geoid AS BIGINT) AS VARCHAR) AS geoid, coalesce(c.pop, 0) AS population
FROM fx_areas a LEFT JOIN fx_demo_city c ON CAST(a.geoid AS BIGINT) = CAST(c.geoid AS BIGINT)""")
_present = [c for c in DEMOGRAPHIC_COLUMNS if c in {"POP", "Total_Households", "Median_HH_Income", *COUNT_MODULI}]
oracle("p8_existing_columns", f"SELECT geoid AS GEOID, {', '.join(_present)} FROM fx_counts")
oracle("p9_rename_map", f"SELECT geoid, {', '.join(LONG_NAMES)} FROM fx_counts")
GEO = [
    "geo AS (SELECT geoid, population, geom_geojson AS g, CASE WHEN json_valid(geom_geojson) "
    "THEN json_extract_string(geom_geojson, '$.type') END AS kind FROM fx_areas)",
    "shapes AS (SELECT geoid, population, CASE kind "
    "WHEN 'Polygon' THEN [TRY_CAST(json_extract(g, '$.coordinates') AS DOUBLE[][][])] "
    "WHEN 'MultiPolygon' THEN TRY_CAST(json_extract(g, '$.coordinates') AS DOUBLE[][][][]) END AS parts FROM geo)",
    "part_rows AS (SELECT geoid, population, generate_subscripts(parts, 1) AS pi, unnest(parts) AS part "
    "FROM shapes WHERE parts IS NOT NULL)",
    "ring_rows AS (SELECT geoid, pi, generate_subscripts(part, 1) AS ri, unnest(part) AS ring FROM part_rows)",
    "vertex_rows AS (SELECT geoid, pi, ri, generate_subscripts(ring, 1) AS vi, unnest(ring) AS pt FROM ring_rows)",
    "xy AS (SELECT geoid, pi, ri, vi, pt[1] AS x, pt[2] AS y FROM vertex_rows)",
]


def centroid(points: str, name: str) -> list[str]:
    """Area-weighted centroid of (geoid, pi, ri, vi, x, y) rows, relative to a first vertex."""
    return [
        f"{name}_shift AS (SELECT *, first_value(x) OVER w AS ox, first_value(y) OVER w AS oy FROM {points} "
        "WINDOW w AS (PARTITION BY geoid ORDER BY pi, ri, vi))",
        f"{name}_edges AS (SELECT geoid, pi, ri, ox, oy, x - ox AS x0, y - oy AS y0, lead(x) OVER w - ox AS x1, "
        f"lead(y) OVER w - oy AS y1 FROM {name}_shift WINDOW w AS (PARTITION BY geoid, pi, ri ORDER BY vi))",
        f"{name}_rings AS (SELECT geoid, ri, ox, oy, sum(x0 * y1 - x1 * y0) AS a, "
        "sum((x0 + x1) * (x0 * y1 - x1 * y0)) AS mx, sum((y0 + y1) * (x0 * y1 - x1 * y0)) AS my "
        f"FROM {name}_edges WHERE x1 IS NOT NULL GROUP BY geoid, pi, ri, ox, oy)",
        f"{name}_sums AS (SELECT geoid, ox, oy, sum(abs(a) * q) AS a, sum(mx * sign(a) * q) AS mx, sum(my * sign(a) * q) AS my "
        f"FROM (SELECT *, CASE WHEN ri = 1 THEN 1 ELSE -1 END AS q FROM {name}_rings) GROUP BY geoid, ox, oy)",
        f"{name} AS (SELECT geoid, mx / (3 * a) + ox AS x, my / (3 * a) + oy AS y FROM {name}_sums)",
    ]


def ring_figures(keep: str) -> str:
    return (f"{keep}, count(*) AS vertices, min(CASE WHEN vi = 1 THEN x END) AS first_lon, "
            "min(CASE WHEN vi = 1 THEN y END) AS first_lat, round(sum(x), 6) AS sum_lon, round(sum(y), 6) AS sum_lat")


oracle("p10_usable_geometry", "SELECT geoid, population FROM shapes WHERE parts IS NOT NULL AND len(parts[1][1]) > 0", *GEO)
oracle("p11_selected_flag", "SELECT geoid, population, geoid IN (SELECT geoid FROM fx_affected) AS selected FROM fx_areas")
oracle("p12_split_by_flag", """SELECT CASE WHEN population % 3 = 0 THEN 'selected' ELSE 'base' END AS layer, count(*) AS areas,
CAST(sum(population) AS BIGINT) AS people FROM fx_areas GROUP BY 1""")
oracle("p13_build_key", """SELECT concat(statefp, countyfp, tractce) AS tract, concat(statefp, countyfp, tractce, blkgrpce) AS block_group,
length(geoid) = 12 AS valid FROM fx_areas""")
oracle("p14_key_parts", "SELECT geoid, statefp, countyfp, tractce, blkgrpce FROM fx_areas")
TEXTS = """texts AS (SELECT geoid, CASE WHEN population % 7 = 0 THEN 'none' WHEN population % 11 = 0 THEN NULL
WHEN population % 5 = 0 THEN concat(CAST(population AS VARCHAR), '.5') ELSE CAST(population AS VARCHAR) END AS stated FROM fx_areas)"""
oracle("p15_number_or_null", "SELECT geoid, TRY_CAST(stated AS DOUBLE) AS value FROM texts", TEXTS)
oracle("p16_number_or_zero", "SELECT geoid, coalesce(TRY_CAST(stated AS DOUBLE), 0) AS value FROM texts", TEXTS)
oracle("p17_fill_numbers", "SELECT geoid, coalesce(pop, 0) AS pop FROM fx_demo_county")
oracle("p18_location_text", """SELECT geoid, concat('Block Group ', blkgrpce, ', St. Louis County, Missouri') AS numbered,
'Block Group, St. Louis County, Missouri' AS location FROM fx_areas""")

# --- joins ---

oracle("j1_priority_merge", """SELECT b.geoid, b.lat, b.lon, coalesce(y.pop, c.pop, 0) AS population FROM fx_areas b
LEFT JOIN fx_demo_city c ON b.geoid = c.geoid LEFT JOIN fx_demo_county y ON b.geoid = y.geoid""")
_child, _elder = half_even(rate(trunc("POP * 0.2::DOUBLE"), "POP")), half_even(rate(trunc("POP * 0.15::DOUBLE"), "POP"))
oracle("j1_prepared_areas", f"""SELECT {ring_figures('m.geoid, m.lat, m.lon, m.population')}
FROM xy JOIN fx_merged m USING (geoid) WHERE pi = 1 AND ri = 1 GROUP BY ALL""", *GEO, MERGED)
oracle("j2_enrich", f"""SELECT b.geoid, b.lat, b.lon, t.POP, t.Low_Income_Rate, t.Total_Dependency_Rate FROM fx_areas b LEFT JOIN (
SELECT geoid, POP, {half_even(rate('Low_Income_HH', 'Total_Households'))} AS Low_Income_Rate,
{half_even(f'{_child} + {_elder}')} AS Total_Dependency_Rate FROM fx_counts WHERE POP % 4 <> 0) t ON b.geoid = t.geoid""")
oracle("j3_radius_join", "SELECT site_id, geoid, population, round(miles, 6) AS distance_miles FROM pairs",
       pairs("fx_areas", "fx_sites", 2.0))
ORACLES["j3_radius_join_hot"] = ORACLES["j3_radius_join"]
oracle("j3_radius_join_copies", """SELECT site_id, geoid, CASE WHEN population % 5 = 0 THEN 40 ELSE 1 END AS rows,
round(miles, 6) AS distance_miles FROM pairs""", pairs("fx_areas", "fx_sites", 1.0))
oracle("j4_not_selected", "SELECT site_id, name, type FROM fx_open WHERE site_id NOT IN (SELECT site_id FROM picks)", *FLAG)
oracle("j5_covered_areas", "SELECT geoid, population FROM fx_demand WHERE geoid IN (SELECT geoid FROM covered)", *FLAG)
_CHECK = """SELECT count(*) AS rows, count(p.geoid) AS matched{extra} FROM {left} b LEFT JOIN fx_demo_county p ON b.geoid = p.geoid"""
_COUNTY = "(SELECT geoid FROM fx_areas WHERE countyfp = '189')"
_FIRST5 = "(SELECT geoid FROM fx_areas WHERE countyfp = '189' ORDER BY geoid LIMIT 5)"
oracle("j6_join_check", _CHECK.format(left=_COUNTY, extra=", 'all' AS checked") + " UNION ALL "
       + _CHECK.format(left=_FIRST5, extra=", 'sample' AS checked"))

# --- aggregations ---

oracle("a1_total_population", "SELECT CAST(sum(population) AS BIGINT) AS total_population FROM fx_demand")
oracle("a2_covered_population", """SELECT CAST(sum(population) AS BIGINT) AS covered_population FROM fx_demand
WHERE geoid IN (SELECT geoid FROM covered)""", *FLAG)
_PERCENT = """round(100.0 * (SELECT sum(population) FROM fx_demand WHERE geoid IN (SELECT geoid FROM covered))::DOUBLE
/ (SELECT sum(population) FROM fx_demand)::DOUBLE, 6)"""
oracle("a3_coverage_percent", f"SELECT {_PERCENT} AS coverage_percent", *FLAG)
oracle("a4_remaining_gain", """SELECT site_id, CAST(sum(population) AS BIGINT) AS gain FROM pairs
WHERE geoid NOT IN (SELECT geoid FROM c1) GROUP BY site_id HAVING sum(population) > 0""", *greedy(1, 5.0))
oracle("a5_best_gain", "SELECT site_id, gain FROM p1", *greedy(1, 5.0))
oracle("a6_row_count", "SELECT count(*) AS block_groups FROM fx_areas")
oracle("a7_distinct_keys", """SELECT count(*) AS rows, count(DISTINCT geoid) AS keys
FROM (SELECT geoid FROM fx_demo_city UNION ALL SELECT geoid FROM fx_demo_county)""")
oracle("a8_null_counts", """SELECT 'geoid' AS column_name, count(*) FILTER (geoid IS NULL) AS null_count FROM fx_demo_county
UNION ALL SELECT 'pop', count(*) FILTER (pop IS NULL) FROM fx_demo_county""")
oracle("a9_zero_counts", "SELECT 'pop' AS column_name, count(*) FILTER (pop = 0) AS zero_count FROM fx_demo_county")
oracle("a10_median", "SELECT median(Median_HH_Income) AS median_income FROM fx_counts")
oracle("a10_medians", """SELECT median(Median_HH_Income)::DOUBLE AS median_income, median(POP)::DOUBLE AS median_people,
median(Total_Households)::DOUBLE AS median_households FROM fx_counts""")
_LOW, _SNAP = half_even(rate("Low_Income_HH", "Total_Households")), half_even(rate("HH_SNAP", "Total_Households"))
oracle("a11_mean_rates", f"SELECT round(avg({_LOW}), 6) AS low_income, round(avg({_SNAP}), 6) AS snap FROM fx_counts")
oracle("a12_view_center", "SELECT round(avg(lat), 6) AS center_lat, round(avg(lon), 6) AS center_lon FROM fx_areas")
oracle("a13_population_text", """SELECT CAST(sum(population) AS BIGINT) AS population,
format('{:,}', CAST(sum(population) AS BIGINT)) AS population_text FROM fx_areas""")
oracle("a14_county_totals", """SELECT CASE WHEN GROUPING(countyfp) = 1 THEN 'Total' ELSE countyfp END AS area, count(*) AS block_groups,
CAST(sum(population) AS BIGINT) AS population, CAST(GROUPING(countyfp) AS INTEGER) AS is_total FROM fx_areas GROUP BY ROLLUP (countyfp)""")
oracle("a15_matched_rows", "SELECT count(c.geoid) AS matched FROM fx_areas a LEFT JOIN fx_demo_city c ON a.geoid = c.geoid")

# --- sorts, limits, sets ---

oracle("t1_county_keys_sorted", "SELECT DISTINCT geoid FROM fx_areas WHERE substring(geoid, 3, 3) = '189' ORDER BY geoid")
oracle("t2_keys_sorted", "SELECT geoid FROM fx_demo_city UNION SELECT geoid FROM fx_demo_county ORDER BY geoid")
oracle("t3_limit", "SELECT geoid, population FROM fx_areas ORDER BY geoid LIMIT 5")
oracle("t4_head_and_tail", """(SELECT geoid, population, 'head' AS part FROM fx_areas ORDER BY geoid LIMIT 5)
UNION ALL (SELECT geoid, population, 'tail' FROM fx_areas ORDER BY geoid DESC LIMIT 5)""")
oracle("t5_top_gain_rounds", "SELECT rank, site_id, gain FROM picks", *greedy(3, 2.0))
oracle("u1_union_first_wins", """SELECT geoid, pop FROM fx_demo_city UNION ALL
SELECT geoid, pop FROM fx_demo_county WHERE geoid NOT IN (SELECT geoid FROM fx_demo_city)""")
oracle("u2_distinct", "SELECT DISTINCT statefp, countyfp FROM fx_areas")
oracle("u3_key_sides", """SELECT coalesce(c.geoid, y.geoid) AS geoid, CASE WHEN y.geoid IS NULL THEN 'left_only'
WHEN c.geoid IS NULL THEN 'right_only' ELSE 'both' END AS side FROM fx_demo_city c FULL JOIN fx_demo_county y ON c.geoid = y.geoid""")
BASE = "anchors AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{n}', {la!r}::DOUBLE, {lo!r}::DOUBLE, {i})" for i, (n, la, lo) in enumerate(sorted(BASE_SITES))
) + ") t(site_id, lat, lon, slot))"
oracle("u4_append_sites", """SELECT CAST(site_id AS VARCHAR) AS site_id, lat, lon FROM fx_sites
UNION ALL SELECT site_id, lat, lon FROM anchors""", BASE)
oracle("u5_covered_keys", "SELECT geoid FROM covered", *FLAG)

# --- demographic metrics ---

_AGES = {n: f"population % {m}" for n, m in AGE_MODULI.items()} | {
    "Male_5_9": "CASE WHEN population % 11 = 0 THEN NULL ELSE population % 31 END",
    "Source_0_17": "population % 333",
    "Source_0_4": "CASE WHEN population % 19 = 0 THEN NULL ELSE population % 77 END",
    "Units_Before_1940": "population % 50",
    "Housing_Age_Universe": "population % 400",
}
_CELLS = {n: _AGES[n] for n in ACS_CELL_NAMES if n in _AGES} | {
    "Children_0_17": _AGES["Source_0_17"], "Children_0_4": _AGES["Source_0_4"],
    "Male_5_9": "CASE WHEN population % 11 = 0 OR population % 71 = 0 THEN NULL ELSE population % 31 END"}
oracle("src6_census_decode_cells", "SELECT geoid AS GEOID, " + ", ".join(
    f"{_CELLS[n]} AS {n}" if n in _CELLS else f"c.{n}" for n in ACS_CELL_NAMES) + " FROM fx_counts c JOIN fx_areas a USING (geoid)")
METRIC_INPUT = (
    "raw AS (SELECT c.*, " + ", ".join(f"{e} AS {n}" for n, e in _AGES.items())
    + " FROM fx_counts c JOIN fx_areas a USING (geoid))"
)
_E65 = {"cells": "coalesce(Male_65_74 + Female_65_74, 0) + coalesce(Male_75_plus + Female_75_plus, 0)",
        "estimate": trunc("POP * 0.15::DOUBLE"), "estimate_known_elderly": "Pop_65_Plus"}
_C17 = {m: trunc("POP * 0.2::DOUBLE") for m in _E65} | {"cells": "Source_0_17"}


def _by_mode(cells: str, estimate: str | dict[str, str]) -> dict[str, str]:
    both = estimate if isinstance(estimate, dict) else {"estimate": estimate, "estimate_known_elderly": estimate}
    return {"cells": cells} | both


def _same(expression: str) -> dict[str, str]:
    return _by_mode(expression, expression)


def _filled(n: str, d: str) -> dict[str, str]:
    """The third mode turns nulls into zeros before dividing, which gives the same rate of 0."""
    return _same(half_even(rate(n, d)))


_METRICS = {
    "m1_low_income_rate": _filled("Low_Income_HH", "Total_Households"),
    "m2_snap_rate": _filled("HH_SNAP", "Total_Households"),
    "m3_public_assistance_rate": _filled("Public_Assistance_HH", "Total_Households"),
    "m4_renter_rate": _filled("Renter_Occupied", "(Total_Housing_Units - Vacant_Housing_Units)"),
    "m5_vacancy_rate": _filled("Vacant_Housing_Units", "Total_Housing_Units"),
    "m6_hh_with_children_rate": _filled("HH_With_Children", "Total_Households"),
    "m7_single_parent_rate": _filled("Single_Parent_HH", "Total_Households"),
    "m8_no_car_rate": _filled("Workers_No_Car", "Total_Workers"),
    "m9_no_internet_rate": _filled("HH_No_Internet", "Total_Households"),
    "m10_children_0_17": _C17,
    "m11_children_0_4": _by_mode("coalesce(Source_0_4, 0)", trunc(f"{_C17['estimate']} * 0.25::DOUBLE")),
    "m12_children_5_17": _by_mode(
        "coalesce(Male_5_9 + Female_5_9 + Male_10_14 + Female_10_14 + Male_15_17 + Female_15_17, 0)",
        trunc(f"{_C17['estimate']} * 0.75::DOUBLE")),
    "m13_child_dependency_rate": {m: half_even(rate(c, "POP")) for m, c in _C17.items()},
    "m14_elderly_65_74": {m: "coalesce(Male_65_74 + Female_65_74, 0)" if m == "cells" else trunc(f"({e}) * 0.6::DOUBLE")
                          for m, e in _E65.items()},
    "m15_elderly_75_plus": {m: "coalesce(Male_75_plus + Female_75_plus, 0)" if m == "cells" else trunc(f"({e}) * 0.4::DOUBLE")
                            for m, e in _E65.items()},
    "m16_elderly_65_plus": _E65,
    "m17_elderly_dependency_rate": {m: half_even(rate(f"({e})", "POP")) for m, e in _E65.items()},
    "m18_total_dependency_rate": {
        m: half_even(f"{half_even(rate(_C17[m], 'POP'))} + {half_even(rate(f'({e})', 'POP'))}" if m == "estimate"
                     else f"{rate(_C17[m], 'POP')} + {rate(f'({e})', 'POP')}")
        for m, e in _E65.items()},
    "m19_built_before_1940": _by_mode("CASE WHEN Median_Year_Built < 1940 THEN 1 ELSE 0 END", "0"),
    "m20_old_housing_rate": _by_mode(half_even(rate("Units_Before_1940", "Housing_Age_Universe")), "0"),
}
for _name, _modes in _METRICS.items():
    _type = "DOUBLE" if _name.endswith("_rate") else "BIGINT"
    oracle(_name, " UNION ALL ".join(
        f"SELECT geoid AS GEOID, '{m}' AS mode, CAST({e} AS {_type}) AS value FROM raw" for m, e in _modes.items()), METRIC_INPUT)
oracle("m21_rounding", f"""SELECT geoid, {half_even('Low_Income_HH::DOUBLE / nullif(Total_Households, 0)::DOUBLE * 100')} AS Some_Rate,
CAST(round_even(POP / 4.0::DOUBLE, 0) AS BIGINT) AS Quarter FROM fx_counts""")
_of = {name: f"CAST({modes['cells']} AS {'DOUBLE' if name.endswith('_rate') else 'BIGINT'})" for name, modes in _METRICS.items()}
_short = {name.split("_", 1)[1]: e for name, e in _of.items()}
oracle("m_full_table", "SELECT geoid AS GEOID, 'Block Group, St. Louis County, Missouri' AS Location, " + ", ".join(
    f"{_short[c.lower()]} AS {c}" if c.lower() in _short else c for c in DEMOGRAPHIC_COLUMNS[2:]) + " FROM raw", METRIC_INPUT)

_chain = {c: _short[c.lower()] if c.lower() in _short else c for c in DEMOGRAPHIC_COLUMNS[2:]} | {"Old_Housing_Rate": "0.0::DOUBLE"}
oracle("src6_cells_to_metrics", "SELECT geoid AS GEOID, 'Block Group, St. Louis County, Missouri' AS Location, "
       + ", ".join(f"{e} AS {c}" for c, e in _chain.items()) + " FROM raw",
       METRIC_INPUT.replace("population % 11 = 0 THEN NULL", "population % 11 = 0 OR population % 71 = 0 THEN NULL"))

# --- geometry and text ---

oracle("geo1_haversine", f"""SELECT a.geoid, b.site_id, round({miles('b', 'a')}, 6) AS miles
FROM fx_areas a JOIN anchors b ON CAST(a.geoid AS BIGINT) % 6 = b.slot""", BASE)
oracle("geo2_centroid", "SELECT geoid, round(y, 6) AS lat, round(x, 6) AS lon FROM centre", *GEO, *centroid("xy", "centre"))


def _sines(terms: list[tuple[float, int]], angle: str) -> str:
    return " + ".join(f"{w!r} * sin({m} * {angle})" for w, m in terms)


# Transverse Mercator after Snyder 1987, one table expression per step.
_UTM = [
    f"tm1 AS (SELECT geoid, pi, ri, vi, radians(y) AS phi, radians(x - ({UTM_MERIDIAN!r})) AS lam FROM xy)",
    f"tm2 AS (SELECT *, tan(phi) ** 2 AS t, {_EP2!r} * cos(phi) ** 2 AS c, lam * cos(phi) AS a, "
    f"{GRS80_A!r} / sqrt(1 - {_E2!r} * sin(phi) ** 2) AS nu, "
    f"{GRS80_A!r} * ({_ARC!r} * phi + {_sines(_ARC_TERMS, 'phi')}) AS m FROM tm1)",
    f"tm AS (SELECT geoid, pi, ri, vi, {UTM_FALSE_EASTING!r} + {UTM_SCALE!r} * nu * (a + (1 - t + c) * a ** 3 / 6 "
    f"+ (5 - 18 * t + t * t + 72 * c - {58 * _EP2!r}) * a ** 5 / 120) AS x, "
    f"{UTM_SCALE!r} * (m + nu * tan(phi) * (a ** 2 / 2 + (5 - t + 9 * c + 4 * c * c) * a ** 4 / 24 "
    f"+ (61 - 58 * t + t * t + 600 * c - {330 * _EP2!r}) * a ** 6 / 720)) AS y FROM tm2)",
]
_BACK = [
    f"inv1 AS (SELECT geoid, x, y / {UTM_SCALE * GRS80_A * _ARC!r} AS mu FROM plane)",
    f"inv2 AS (SELECT geoid, x, mu + {_sines(_FOOT_TERMS, 'mu')} AS p FROM inv1)",
    f"inv3 AS (SELECT geoid, p, tan(p) ** 2 AS t, {_EP2!r} * cos(p) ** 2 AS c, "
    f"{GRS80_A!r} / sqrt(1 - {_E2!r} * sin(p) ** 2) AS n, "
    f"{GRS80_A * (1 - _E2)!r} / (1 - {_E2!r} * sin(p) ** 2) ** 1.5 AS r, x FROM inv2)",
    f"inv4 AS (SELECT *, (x - {UTM_FALSE_EASTING!r}) / (n * {UTM_SCALE!r}) AS d FROM inv3)",
    "back AS (SELECT geoid, degrees(p - n * tan(p) / r * (d ** 2 / 2 "
    f"- (5 + 3 * t + 10 * c - 4 * c * c - {9 * _EP2!r}) * d ** 4 / 24 "
    f"+ (61 + 90 * t + 298 * c + 45 * t * t - {252 * _EP2!r} - 3 * c * c) * d ** 6 / 720)) AS lat, "
    f"{UTM_MERIDIAN!r} + degrees((d - (1 + 2 * t + c) * d ** 3 / 6 "
    f"+ (5 - 2 * c + 28 * t - 3 * c * c + {8 * _EP2!r} + 24 * t * t) * d ** 5 / 120) / cos(p)) AS lon FROM inv4)",
]
oracle("geo3_projected_centroid", "SELECT geoid, round(lat, 7) AS lat, round(lon, 7) AS lon FROM back",
       *GEO, *_UTM, *centroid("tm", "plane"), *_BACK)


oracle("geo4_first_outer_ring", f"SELECT {ring_figures('geoid')} FROM xy WHERE pi = 1 AND ri = 1 GROUP BY geoid", *GEO)
oracle("geo5_polygon_parts", f"""SELECT {ring_figures('geoid, population')} FROM xy JOIN fx_areas USING (geoid)
WHERE ri = 1 GROUP BY geoid, population, pi""", *GEO)


def number_text(value: str) -> str:
    """A whole number keeps one decimal, as a double printed by the other side does."""
    return f"CAST({value} AS VARCHAR)"


_PT = f"concat('[', {number_text('v[1]')}, ',', {number_text('v[2]')}, ']')"
_RINGTEXT = f"concat('[', array_to_string(list_transform(r, lambda v: {_PT}), ','), ']')"
_PARTTEXT = f"concat('[', array_to_string(list_transform(p, lambda r: {_RINGTEXT}), ','), ']')"
GEOJSON = (
    "CASE WHEN len(parts) = 1 THEN concat('{\"type\":\"Polygon\",\"coordinates\":', "
    f"list_transform(parts, lambda p: {_PARTTEXT})[1], '}}') ELSE concat('{{\"type\":\"MultiPolygon\",\"coordinates\":[', "
    f"array_to_string(list_transform(parts, lambda p: {_PARTTEXT}), ','), ']}}') END"
).replace("{{", "{").replace("}}", "}")
oracle("geo6_to_geojson", f"SELECT geoid, {GEOJSON} AS geojson FROM shapes WHERE parts IS NOT NULL", *GEO)
oracle("snk4_boundary_table", f"""SELECT a.geoid, a.statefp, a.countyfp, a.tractce, a.blkgrpce, round(c.y, 6) AS lat, round(c.x, 6) AS lon,
CASE WHEN parts IS NOT NULL THEN {GEOJSON} END AS geom_geojson
FROM fx_areas a JOIN shapes s USING (geoid) LEFT JOIN centre c USING (geoid)""", *GEO, *centroid("xy", "centre"))
oracle("geo7_parse_geojson", """SELECT geoid, count(DISTINCT pi) AS parts, count(*) AS rings FROM ring_rows GROUP BY geoid""", *GEO)
_LABEL = """CASE {t} WHEN 'school' THEN 'School' WHEN 'place_of_worship' THEN 'Place Of Worship' WHEN 'community_centre'
THEN 'Community Centre' WHEN 'fire_station' THEN 'Fire Station' WHEN 'library' THEN 'Library' ELSE 'Warehouse' END"""
oracle("str1_type_label", f"SELECT site_id, {_LABEL.format(t='type')} AS label FROM fx_sites")
oracle("str2_area_label", "SELECT geoid, concat('Block Group ', geoid) AS label FROM fx_areas")
_POP_LABEL = "concat('Census Block Group (Pop: ', CAST(population AS VARCHAR), ')')"
oracle("str3_population_label", f"SELECT geoid, {_POP_LABEL} AS label FROM fx_areas")
oracle("fmt1_number_texts", f"""SELECT c.geoid AS GEOID, format('{{:,}}', Median_HH_Income) AS income,
concat(format('{{:.1f}}', {_SNAP}), '%') AS snap, format('{{:.4f}}', lat) AS latitude
FROM fx_counts c JOIN fx_areas a ON c.geoid = a.geoid""")
oracle("rnd1_lower_bound", "SELECT geoid, greatest(5000, population) AS at_least FROM fx_areas")

# --- coverage ---

oracle("g1_greedy", """SELECT CAST(rank AS INTEGER) AS rank, s.*, gain, CAST(sum(gain) OVER (ORDER BY rank) AS BIGINT) AS cumulative_population
FROM picks JOIN fx_sites s USING (site_id)""", *FLAG)
_RANKED = """SELECT CAST(rank AS INTEGER) AS rank, site_id, gain, CAST(sum(gain) OVER (ORDER BY rank) AS BIGINT) AS cumulative_population
FROM picks"""
oracle("g1_greedy_rounds", _RANKED, *greedy(18, 2.0))
oracle("g1_greedy_frontier", _RANKED, *greedy(10, 2.0))
oracle("g1_greedy_cells", _RANKED, *greedy(3, 5.0))
oracle("g1_greedy_hot", _RANKED, *greedy(3, 5.0))


def _summary(demand: str, covered: str) -> str:
    """Totals of a demand table and of its rows that satisfy a condition."""
    total, part = f"(SELECT sum(population) FROM {demand})", f"(SELECT sum(population) FROM {demand} WHERE {covered})"
    return (
        f"SELECT CAST({total} AS BIGINT) AS total_population, CAST({part} AS BIGINT) AS covered_population, "
        f"round(100.0 * {part}::DOUBLE / {total}::DOUBLE, 6) AS coverage_percent, "
        "CAST((SELECT count(*) FROM picks) AS INTEGER) AS selected_count"
    )


oracle("g2_repeated_keys", _summary("fx_demand", "substring(geoid, 1, 11) IN (SELECT substring(geoid, 1, 11) FROM covered)"), *greedy(3, 2.0))
oracle("cache2_drawable_areas_only", _summary("fx_drawn", "geoid IN (SELECT geoid FROM covered)"), MERGED,
       "fx_drawn AS (SELECT * FROM fx_merged_demand WHERE geoid IN (SELECT geoid FROM fx_areas "
       "WHERE starts_with(geom_geojson, '{\"type\":\"Polygon\"') OR starts_with(geom_geojson, '{\"type\":\"MultiPolygon\"')))",
       *greedy(3, 5.0, "fx_drawn"))
oracle("g2_run_summary", f"""SELECT CAST((SELECT sum(population) FROM fx_demand) AS BIGINT) AS total_population,
CAST((SELECT sum(population) FROM fx_demand WHERE geoid IN (SELECT geoid FROM covered)) AS BIGINT) AS covered_population,
{_PERCENT} AS coverage_percent, CAST((SELECT count(*) FROM picks) AS INTEGER) AS selected_count""", *FLAG)
oracle("g3_covered_flag", "SELECT geoid, population, geoid IN (SELECT geoid FROM covered) AS covered FROM fx_demand", *FLAG)
oracle("g4_site_reach", """SELECT s.site_id, CAST(coalesce(sum(p.population), 0) AS BIGINT) AS reach_population
FROM fx_sites s LEFT JOIN pairs p USING (site_id) GROUP BY s.site_id""", pairs("fx_demand", "fx_sites", 2.0))

ORACLES["g4_site_reach_cells"] = ORACLES["g4_site_reach"]

# --- generators ---


def uniform(stream: str, row_id: str) -> str:
    return f"(CAST(('0x' || substr(md5(concat('42|{stream}|', CAST({row_id} AS VARCHAR))), 1, 8)) AS BIGINT) / {float(2**32)!r}::DOUBLE)"


def between(stream: str, row_id: str, low: float, high: float) -> str:
    return f"({low!r}::DOUBLE + ({high!r}::DOUBLE - ({low!r}::DOUBLE)) * {uniform(stream, row_id)})"


def normal(stream: str, row_id: str, mean: float, deviation: float) -> str:
    return (f"({mean!r}::DOUBLE + {deviation!r}::DOUBLE * sqrt(-2 * ln(1 - {uniform(stream + '-radius', row_id)})) "
            f"* cos({2 * math.pi!r}::DOUBLE * {uniform(stream + '-turn', row_id)}))")


_ANCHORS = "anchor_list AS (SELECT * FROM (VALUES " + ", ".join(
    f"({i}, '{n}', {la!r}::DOUBLE, {lo!r}::DOUBLE)" for i, (n, la, lo) in enumerate(BASE_SITES)) + ") t(i, site_id, lat, lon))"
oracle("gen1_scatter_sites", f"""SELECT CASE WHEN {uniform('kind', 'k')} < 0.3::DOUBLE THEN concat('site_rand_', k + 1) ELSE concat('site_jitter_', k + 1) END AS site_id,
round(CASE WHEN {uniform('kind', 'k')} < 0.3::DOUBLE THEN {between('lat', 'k', 38.4, 38.9)} ELSE a.lat + {between('jitter-lat', 'k', -0.035, 0.035)} END, 9) AS lat,
round(CASE WHEN {uniform('kind', 'k')} < 0.3::DOUBLE THEN {between('lon', 'k', -90.74, -90.12)} ELSE a.lon + {between('jitter-lon', 'k', -0.035, 0.035)} END, 9) AS lon
FROM (SELECT c_custkey AS k FROM customer) JOIN anchor_list a ON a.i = CAST(floor({uniform('anchor', 'k')} * 6) AS INTEGER)
UNION ALL SELECT site_id, lat, lon FROM anchor_list""", _ANCHORS)
oracle("gen2_base_site_reach", """SELECT s.site_id, CAST(coalesce(sum(p.population), 0) AS BIGINT) AS reach_population
FROM anchors s LEFT JOIN pairs p USING (site_id) GROUP BY s.site_id""", BASE, pairs("fx_areas", "anchors", 10.0))
_syn = {n: trunc(f"hh * {s!r}::DOUBLE") for n, s in HOUSEHOLD_SHARES.items()}
_syn |= {n: trunc(f"pop * {s!r}::DOUBLE") for n, s in PEOPLE_SHARES.items()}
_syn |= {n: f"{v!r}::DOUBLE" for n, v in CONSTANT_RATES.items()}
_syn |= {"GEOID": "geoid", "Location": "'Block Group, St. Louis County, Missouri'", "POP": "pop", "Total_Households": "hh",
         "Median_HH_Income": "income", "Built_Before_1940": "0", "Workers_No_Car": trunc("pop * 0.4::DOUBLE * 0.08::DOUBLE")}
oracle("gen3_synthetic_demographics", "SELECT " + ", ".join(f"{_syn[c]} AS {c}" for c in DEMOGRAPHIC_COLUMNS) + " FROM drawn",
       f"people AS (SELECT geoid, greatest(100, {trunc(normal('population', 'geoid', 1340.0, 402.0))}) AS pop, "
       f"{trunc(normal('income', 'geoid', 81441.0, 15000.0))} AS income FROM fx_areas WHERE countyfp = '189')",
       f"drawn AS (SELECT *, greatest(40, {trunc('pop / 2.5::DOUBLE')}) AS hh FROM people)")

# --- checks and reports ---


def _line(table: str, label: str, column: str, kind: str, width: int, distinct: bool, numeric: bool) -> str:
    return (
        f"SELECT '{label}' AS table_name, '{column}' AS column_name, '{kind}' AS data_type, {width} AS column_count, "
        f"count(*) AS row_count, {f'count(DISTINCT {column})' if distinct else 'CAST(NULL AS BIGINT)'} AS distinct_count, "
        f"count(*) FILTER ({column} IS NULL) AS null_count, "
        f"{f'count(*) FILTER ({column} = 0)' if numeric else 'CAST(NULL AS BIGINT)'} AS zero_count FROM {table}"
    )


oracle("q1_completeness", " UNION ALL ".join([
    _line("fx_demo_county", "county", "geoid", "string", 2, True, False),
    _line("fx_demo_county", "county", "pop", "bigint", 2, False, True),
    _line("fx_areas", "boundaries", "geoid", "string", 9, True, False),
    _line("fx_areas", "boundaries", "population", "bigint", 9, False, True),
    _line("fx_areas", "boundaries", "geom_geojson", "string", 9, False, False),
]))
oracle("q1_distinct_columns", " UNION ALL ".join([
    _line("fx_areas", "boundaries", "geoid", "string", 9, True, False),
    _line("fx_areas", "boundaries", "countyfp", "string", 9, True, False),
    _line("fx_areas", "boundaries", "tractce", "string", 9, True, False),
    _line("fx_areas", "boundaries", "population", "bigint", 9, True, True),
    _line("fx_areas", "boundaries", "lat", "double", 9, True, True),
    _line("fx_areas", "boundaries", "geom_geojson", "string", 9, False, False),
]))
oracle("q1_samples", "SELECT geoid AS sample FROM fx_demo_county ORDER BY geoid LIMIT 3")
_ONLY_L = "(SELECT count(*) FROM fx_areas WHERE geoid NOT IN (SELECT geoid FROM fx_demo_county))"
_ONLY_R = "(SELECT count(*) FROM fx_demo_county WHERE geoid NOT IN (SELECT geoid FROM fx_areas))"
_BOTH = "(SELECT count(*) FROM fx_areas WHERE geoid IN (SELECT geoid FROM fx_demo_county))"
oracle("q2_key_alignment", f"""SELECT 'left_only' AS side, {_ONLY_L} AS keys UNION ALL SELECT 'right_only', {_ONLY_R}
UNION ALL SELECT 'both', {_BOTH}""")
oracle("q2_alignment_verdict", f"""SELECT {_ONLY_L} AS left_only, {_ONLY_R} AS right_only, {_BOTH} AS both,
CASE WHEN {_ONLY_L} > 0 THEN 'some areas lack demographic data' ELSE 'all areas have demographic data' END AS verdict""")
oracle("q2_key_examples", """SELECT geoid, 'left_only' AS side FROM fx_areas
WHERE geoid NOT IN (SELECT geoid FROM fx_demo_city) ORDER BY geoid LIMIT 5""")
oracle("q3_join_verdict", "SELECT *, CASE WHEN rows = matched THEN 'all keys match' ELSE 'some keys do not match' END AS verdict FROM ("
       + _CHECK.format(left=_COUNTY, extra="") + ")")
oracle("r1_load_summary", f"""SELECT count(*) AS block_groups, CAST(sum(POP) AS BIGINT) AS total_population,
round(avg({_LOW}), 6) AS mean_low_income_rate, round(avg({_SNAP}), 6) AS mean_snap_rate,
median(Median_HH_Income) AS median_income FROM fx_counts""")
oracle("r2_affected_summary", """SELECT count(*) AS areas, CAST(sum(population) AS BIGINT) AS people,
format('{:,}', CAST(sum(population) AS BIGINT)) AS people_text FROM fx_demand""")
oracle("r3_results_table", f"""SELECT CAST(rank AS INTEGER) AS rank, s.name AS Name, {_LABEL.format(t='s.type')} AS Type,
format('{{:.4f}}', s.lat) AS Latitude, format('{{:.4f}}', s.lon) AS Longitude FROM picks JOIN fx_sites s USING (site_id)""", *FLAG)
oracle("r3_metrics_text", f"""SELECT format('{{:,}}', CAST((SELECT sum(population) FROM fx_demand) AS BIGINT)) AS affected_population,
format('{{:,}}', CAST((SELECT sum(population) FROM fx_demand WHERE geoid IN (SELECT geoid FROM covered)) AS BIGINT)) AS covered_population,
concat(format('{{:.1f}}', {_PERCENT}), '%') AS coverage, CAST((SELECT count(*) FROM picks) AS VARCHAR) AS centers_selected""", *FLAG)
oracle("r4_area_features", f"""SELECT {ring_figures('geoid, population')}, population % 3 = 0 AS selected,
concat('Block Group ', geoid) AS name, {_POP_LABEL} AS type_display FROM xy JOIN fx_areas USING (geoid)
WHERE ri = 1 GROUP BY geoid, population, pi""", *GEO)
oracle("r4_demand_points", "SELECT geoid, lat, lon FROM fx_demand")
oracle("r4_site_features", f"""SELECT site_id, name, type, lat, lon,
CASE WHEN site_id IN (SELECT site_id FROM picks) THEN 'selected' ELSE type END AS layer, {_LABEL.format(t='type')} AS type_display
FROM fx_open""", *FLAG)

ORACLES["r4_features_json"] = ORACLES["r4_site_features"]


def _desc(name: str, text: str) -> str:
    return f"'{name}: ' || {text}"


def _pct(expression: str) -> str:
    return f"format('{{:.1f}}', {expression}) || '%'"


_renter = half_even(rate("Renter_Occupied", "(Total_Housing_Units - Vacant_Housing_Units)"))
_DESCRIBED = [
    "'GEOID: ' || geoid",
    _desc("POP", "format('{:,}', POP)"),
    _desc("Median_HH_Income", "format('{:,}', Median_HH_Income)"),
    _desc("Low_Income_Rate", _pct(_LOW)),
    _desc("Child_Dependency_Rate", _pct(_child)),
    _desc("Elderly_Dependency_Rate", _pct(_elder)),
    _desc("Renter_Rate", _pct(_renter)),
    _desc("Vacancy_Rate", _pct(half_even(rate("Vacant_Housing_Units", "Total_Housing_Units")))),
    _desc("No_Internet_Rate", _pct(half_even(rate("HH_No_Internet", "Total_Households")))),
]
oracle("r5_area_description", "SELECT geoid AS GEOID, concat_ws('; ', " + ", ".join(
    f"CASE WHEN POP % 5 > 0 THEN {t} END" if "Renter" in t else t for t in _DESCRIBED) + ") AS description FROM fx_counts")
oracle("r5_map_tables", "SELECT a.geoid, round(b.lat, 7) AS lat, round(b.lon, 7) AS lon, t.POP, "
       "coalesce(t.description, 'GEOID: ' || a.geoid) AS description FROM fx_areas a LEFT JOIN back b USING (geoid) LEFT JOIN ("
       "SELECT geoid, POP, concat_ws('; ', " + ", ".join(
           [_DESCRIBED[0], "'Location: Block Group, St. Louis County, Missouri'", *_DESCRIBED[1:]])
       + ") AS description FROM fx_counts WHERE POP % 4 <> 0) t ON a.geoid = t.geoid",
       *GEO, *_UTM, *centroid("tm", "plane"), *_BACK)
