"""Vulnerability metrics per area, as column expressions over raw counts."""

from __future__ import annotations

from collections.abc import Collection, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catchment.functions.rates import (
    number_or_zero_sql,
    rate_sql,
    round_half_even_sql,
    truncated_share_sql,
)
from catchment.schemas import DEMOGRAPHIC_COLUMNS

# Rates of two counts (fixed values): name, numerator, denominator.
COUNT_RATES = (
    ("Low_Income_Rate", "Low_Income_HH", "Total_Households"),
    ("SNAP_Rate", "HH_SNAP", "Total_Households"),
    ("Public_Assistance_Rate", "Public_Assistance_HH", "Total_Households"),
    ("Renter_Rate", "Renter_Occupied", "(Total_Housing_Units - Vacant_Housing_Units)"),
    ("Vacancy_Rate", "Vacant_Housing_Units", "Total_Housing_Units"),
    ("HH_With_Children_Rate", "HH_With_Children", "Total_Households"),
    ("Single_Parent_Rate", "Single_Parent_HH", "Total_Households"),
    ("No_Car_Rate", "Workers_No_Car", "Total_Workers"),
    ("No_Internet_Rate", "HH_No_Internet", "Total_Households"),
)

# Age-sex cells summed into age groups (fixed values).
AGE_CELLS = {
    "Children_5_17": (
        "Male_5_9", "Female_5_9", "Male_10_14", "Female_10_14", "Male_15_17", "Female_15_17",
    ),
    "Elderly_65_74": ("Male_65_74", "Female_65_74"),
    "Elderly_75_Plus": ("Male_75_plus", "Female_75_plus"),
}

# Shares used where no age detail is at hand (fixed values).
CHILD_SHARE, ELDERLY_SHARE = 0.2, 0.15
YOUNG_CHILD_SHARE, SCHOOL_CHILD_SHARE = 0.25, 0.75
YOUNG_ELDERLY_SHARE, OLD_ELDERLY_SHARE = 0.6, 0.4

MODES = ("cells", "estimate", "estimate_known_elderly")


# Housing by age, for the rate of old housing.
HOUSING_AGE = ("Units_Before_1940", "Housing_Age_Universe")


def _require(df: DataFrame, columns: Collection[str], absent: Collection[str]) -> None:
    missing = sorted(set(columns) - set(df.columns) - set(absent))
    if missing:
        raise ValueError(f"columns {missing} are missing; name them as absent if they are not to count")


def _cell_sum(cells: Sequence[str], absent: Collection[str]) -> str:
    """Sum of the cells at hand; a single null cell makes the whole sum 0."""
    known = [c for c in cells if c not in absent]
    return f"coalesce(cast({' + '.join(known) or '0'} AS bigint), 0L)"


def derive_metrics(
    df: DataFrame, mode: str = "cells", unit: str = "percent", on_zero: str = "zero", absent: Collection[str] = ()
) -> DataFrame:
    """Adds all derived counts and rates, rates rounded to two decimals.

    ``cells`` takes age groups from age-sex cells.  ``estimate`` derives them from
    the population by fixed shares, and ``estimate_known_elderly`` does so except
    for the people over 65, which it takes from ``Pop_65_Plus``.  Columns of age cells
    or housing age that the table does not have must be named as ``absent``; they count as 0.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}, got {mode!r}")

    def share(numerator: str, denominator: str) -> str:
        return rate_sql(numerator, denominator, on_zero, unit)

    digits = 2 if unit == "percent" else 4

    def rounded(value: str) -> Column:
        return F.expr(round_half_even_sql(f"({value})", digits))

    if mode == "estimate_known_elderly":
        counts = [c for n in COUNT_RATES for c in n[1:] if c in df.columns] + ["POP", "Pop_65_Plus"]
        df = df.withColumns({c: F.expr(number_or_zero_sql(c, "double")) for c in dict.fromkeys(counts)})

    df = df.withColumns({name: rounded(share(n, d)) for name, n, d in COUNT_RATES})

    if mode == "cells":
        _require(df, [c for cells in AGE_CELLS.values() for c in cells] + list(HOUSING_AGE), absent)
        df = df.withColumns(
            {"Children_0_4": F.coalesce("Children_0_4", F.lit(0))}
            | {name: F.expr(_cell_sum(cells, absent)) for name, cells in AGE_CELLS.items()}
        )
        df = df.withColumn("Elderly_65_Plus", F.expr("Elderly_65_74 + Elderly_75_Plus"))
        df = df.withColumns(
            {
                "Built_Before_1940": F.expr("coalesce(cast(Median_Year_Built < 1940 AS bigint), 0L)"),
                "Old_Housing_Rate": rounded(share("Units_Before_1940", "Housing_Age_Universe"))
                if not set(HOUSING_AGE) & set(absent)
                else F.lit(0.0),
            }
        )
    else:
        elderly = "Pop_65_Plus" if mode == "estimate_known_elderly" else truncated_share_sql("POP", ELDERLY_SHARE)
        df = df.withColumns(
            {
                "Children_0_17": F.expr(truncated_share_sql("POP", CHILD_SHARE)),
                "Elderly_65_Plus": F.expr(f"cast({elderly} AS bigint)"),
            }
        ).withColumns(
            {
                "Children_0_4": F.expr(truncated_share_sql("Children_0_17", YOUNG_CHILD_SHARE)),
                "Children_5_17": F.expr(truncated_share_sql("Children_0_17", SCHOOL_CHILD_SHARE)),
                "Elderly_65_74": F.expr(truncated_share_sql("Elderly_65_Plus", YOUNG_ELDERLY_SHARE)),
                "Elderly_75_Plus": F.expr(truncated_share_sql("Elderly_65_Plus", OLD_ELDERLY_SHARE)),
                "Built_Before_1940": F.lit(0).cast("bigint"),
                "Old_Housing_Rate": F.lit(0.0),
            }
        )

    child, elderly = share("Children_0_17", "POP"), share("Elderly_65_Plus", "POP")
    # The plain estimate adds rates that are already rounded, the others exact ones.
    both = "Child_Dependency_Rate + Elderly_Dependency_Rate" if mode == "estimate" else f"{child} + {elderly}"
    return df.withColumns(
        {"Child_Dependency_Rate": rounded(child), "Elderly_Dependency_Rate": rounded(elderly)}
    ).withColumn("Total_Dependency_Rate", rounded(both))


def round_numbers(df: DataFrame, skip: Sequence[str] = ()) -> DataFrame:
    """Rates to two decimals, all other numbers to whole ones; null stays null."""
    changed = {}
    for name, kind in df.dtypes:
        if name in skip or kind not in ("double", "float", "bigint", "int"):
            continue
        if "Rate" in name:
            changed[name] = F.expr(round_half_even_sql(f"`{name}`"))
        elif kind in ("double", "float"):
            changed[name] = F.expr(f"cast(rint(`{name}`) AS bigint)")
    return df.withColumns(changed) if changed else df


def existing_columns(df: DataFrame, order: Sequence[str] = DEMOGRAPHIC_COLUMNS) -> DataFrame:
    """Those of the listed columns that exist, in the listed order."""
    return df.select(*[c for c in order if c in df.columns])


def fill_numbers(df: DataFrame) -> DataFrame:
    return df.na.fill(0)


def with_location(df: DataFrame, place: str, number: str | None = None) -> DataFrame:
    """Adds ``Location``: the place, after the area's own number where one is given."""
    if number is None:
        return df.withColumn("Location", F.lit(f"Block Group, {place}"))
    return df.withColumn(
        "Location", F.concat(F.lit("Block Group "), F.col(number).cast("string"), F.lit(f", {place}"))
    )


def demographic_table(
    df: DataFrame, place: str, mode: str = "cells", number: str | None = None, **options
) -> DataFrame:
    """Raw counts to the full demographic table in its fixed column order."""
    table = existing_columns(round_numbers(with_location(derive_metrics(df, mode, **options), place, number)))
    return fill_numbers(table) if mode == "estimate" else table
