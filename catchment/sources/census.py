"""Decoding of census responses: a JSON array of rows whose first row is the header."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catchment.functions.rates import number_or_null_sql, number_or_zero_sql

BLOCK_GROUP_CODES = ("state", "county", "tract", "block group")
TRACT_CODES = ("state", "county", "tract")

# Coded variables and the count each holds (fixed values).
ACS_VARIABLES = {
    "B01003_001E": "POP",
    "B11001_001E": "Total_Households",
    "B19013_001E": "Median_HH_Income",
    "B17001_002E": "Low_Income_HH",
    "B22001_002E": "HH_SNAP",
    "B11005_002E": "Public_Assistance_HH",
    "B25001_001E": "Total_Housing_Units",
    "B25003_003E": "Renter_Occupied",
    "B25002_003E": "Vacant_Housing_Units",
    "B08006_001E": "Total_Workers",
    "B08014_002E": "Workers_No_Car",
    "B28002_002E": "HH_No_Internet",
    "B11001_006E": "HH_With_Children",
    "B11001_008E": "Single_Parent_HH",
}

# The same for the variant with age-sex cells (fixed values).
ACS_CELL_VARIABLES = {
    "B01003_001E": "POP",
    "B11001_001E": "Total_Households",
    "B19013_001E": "Median_HH_Income",
    "B17001_002E": "Low_Income_HH",
    "B22001_002E": "HH_SNAP",
    "B09001_001E": "Children_0_17",
    "B01001_003E": "Children_0_4",
    "B01001_027E": "Female_0_4",
    "B01001_006E": "Male_5_9",
    "B01001_030E": "Female_5_9",
    "B01001_007E": "Male_10_14",
    "B01001_031E": "Female_10_14",
    "B01001_008E": "Male_15_17",
    "B01001_032E": "Female_15_17",
    "B01001_020E": "Male_65_74",
    "B01001_044E": "Female_65_74",
    "B01001_021E": "Male_75_plus",
    "B01001_045E": "Female_75_plus",
    "B11001_006E": "HH_With_Children",
    "B11001_008E": "Single_Parent_HH",
    "B25003_003E": "Renter_Occupied",
    "B25001_001E": "Total_Housing_Units",
    "B25002_003E": "Vacant_Housing_Units",
    "B25035_001E": "Median_Year_Built",
    "B08006_001E": "Total_Workers",
    "B08006_008E": "Workers_No_Car",
    "B28003_002E": "HH_No_Internet",
    "B11005_002E": "Public_Assistance_HH",
}
# Long names of counts and the names the metrics use (fixed values).
LONG_NAMES = {
    "Below_Poverty_Level": "Low_Income_HH",
    "SNAP_Participants": "HH_SNAP",
    "Public_Assistance": "Public_Assistance_HH",
    "Families_With_Children": "HH_With_Children",
    "Single_Parent_Families": "Single_Parent_HH",
    "Workers_16_Plus": "Total_Workers",
    "Workers_No_Vehicle": "Workers_No_Car",
    "No_Internet_Access": "HH_No_Internet",
}


def response_rows(responses: DataFrame, column: str, names: Sequence[str]) -> DataFrame:
    """One row per data row, with the named fields as text columns.

    Fields are found by header name, once per response; a missing field is null.  What ``response_rejects``
    tells of is left out.
    """
    positions = ", ".join(f"array_position(header, '{n}')" for n in names)
    return (
        _lines(responses, column)
        .select("lines", "header", F.expr(f"array({positions})").alias("at"))
        .select("at", F.expr(f"explode(filter(lines, (line, i) -> i > 0 AND {_FITS}))").alias("line"))
        .select(*[F.expr(f"get(line, cast(at[{i}] AS int) - 1)").alias(n) for i, n in enumerate(names)])
    )


_FITS = "coalesce(size(line) = size(header), false)"


def _lines(responses: DataFrame, column: str, *keep: str) -> DataFrame:
    lines = responses.select(*keep, F.col(column).alias("text"), F.from_json(column, "array<array<string>>").alias("lines"))
    return lines.select("*", F.expr("get(lines, 0)").alias("header"))


def response_rejects(responses: DataFrame, column: str, keep: Sequence[str] = ()) -> DataFrame:
    """What ``response_rows`` leaves out: the columns of ``keep``, ``line``, ``reason`` and ``text``.

    A response as a whole has a null ``line`` and its own text: ``no response`` for null, ``no array of rows`` for
    anything that does not parse as one, ``no header``, or ``no data row``.  Data rows, numbered from 1, are rejected
    if they do not have as many fields as the header.
    """
    whole = (
        "CASE WHEN text IS NULL THEN 'no response' WHEN lines IS NULL THEN 'no array of rows' "
        "WHEN coalesce(size(header), 0) = 0 THEN 'no header' WHEN size(lines) = 1 THEN 'no data row' END"
    )
    row = "named_struct('line', {line}, 'reason', {reason}, 'text', {text})"
    broken = row.format(line="cast(NULL AS int)", reason="whole", text="text")
    numbered = f"filter(transform(lines, (line, i) -> named_struct('i', i, 'line', line, 'fits', {_FITS})), x -> x.i > 0 AND NOT x.fits)"
    misfits = f"transform({numbered}, x -> {row.format(line='x.i', reason=repr('fields differ from header'), text='to_json(x.line)')})"
    return (
        _lines(responses, column, *keep).selectExpr("*", f"{whole} AS whole")
        .selectExpr(*keep, f"inline(CASE WHEN whole IS NOT NULL THEN array({broken}) ELSE {misfits} END)")
    )


def rename_coded(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Coded columns under their readable names, all other columns as they are."""
    return df.withColumnsRenamed(dict(names))


def decode_block_groups(
    responses: DataFrame,
    column: str = "response",
    variables: Mapping[str, str] = ACS_VARIABLES,
    bad_is_zero: bool = True,
) -> DataFrame:
    """``GEOID`` and the named counts; a count that is no whole number becomes 0, or null if so asked."""
    rows = response_rows(responses, column, [*BLOCK_GROUP_CODES, *variables])
    count = number_or_zero_sql if bad_is_zero else number_or_null_sql
    counted = rows.select(
        F.concat(*[F.col(f"`{c}`") for c in BLOCK_GROUP_CODES]).alias("GEOID"),
        *[F.expr(count(v, "bigint")).alias(v) for v in variables],
    )
    return rename_coded(counted, variables)


def decode_tracts(responses: DataFrame, column: str = "response", population: str = "B01001_001E") -> DataFrame:
    """``GEOID, NAME, POP`` per tract; a population that is no number becomes null."""
    rows = response_rows(responses, column, [*TRACT_CODES, "NAME", population])
    return rows.select(
        F.concat(*TRACT_CODES).alias("GEOID"), "NAME", F.expr(number_or_null_sql(population)).alias("POP")
    )
