"""Texts and number formats for people."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def type_label(kind: str) -> Column:
    """``place_of_worship`` becomes ``Place Of Worship``."""
    return F.initcap(F.replace(F.col(kind), F.lit("_"), F.lit(" ")))


def area_label(geoid: str) -> Column:
    return F.concat(F.lit("Block Group "), F.col(geoid).cast("string"))


def population_label(population: str) -> Column:
    return F.concat(
        F.lit("Census Block Group (Pop: "), F.col(population).cast("bigint").cast("string"), F.lit(")")
    )


def count_text(value: str) -> Column:
    """Thousands separated, no decimals."""
    return F.format_number(F.col(value).cast("double"), 0)


def percent_text(value: str, unit: str = "percent") -> Column:
    """One decimal and a percent sign, no separators; the unit of the value is stated, not guessed."""
    scale = {"percent": 1.0, "fraction": 100.0}[unit]
    number = F.format_number(F.col(value).cast("double") * scale, 1)
    return F.concat(F.replace(number, F.lit(","), F.lit("")), F.lit("%"))


def coordinate_text(value: str) -> Column:
    return F.format_number(F.col(value), 4)
