"""Latitude/longitude grid that turns a radius search into an equi-join.

A *block* is at least one radius tall and wide, so everything within the radius
of a point lies in the blocks its bounding box touches.  Rows of blocks are
bands of latitude; each band has its own number of columns, chosen from the
latitudes of that band alone.  No statistics of the data are needed, bands near
a pole fall back to a single column, and columns wrap at the 180 degree meridian.

Inside a block, rows and columns are divided 4096 times; the sub-indices of a
coarser level are the leading bits, eight-fold finer per level.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame

from catchment.functions.geodesy import central_angle, sql_number

MAX_LEVEL = 4
LEVEL_BITS = 3
_FINEST = 1 << (MAX_LEVEL * LEVEL_BITS)
_ROW_STRIDE = 1 << 32
# Widens every angle a little, so rounding can never drop a pair.
_PAD = 1.0001
_SMALLEST_ANGLE = 1e-7
_BLOCK = f"_band * {_ROW_STRIDE}L + pmod({{column}}, _n)"


@dataclass(frozen=True)
class Grid:
    radius_miles: float

    def __post_init__(self) -> None:
        if not self.radius_miles >= 0:
            raise ValueError(f"radius must be zero or more, got {self.radius_miles}")

    @property
    def angle(self) -> float:
        return max(central_angle(self.radius_miles), _SMALLEST_ANGLE) * _PAD

    @property
    def band_degrees(self) -> float:
        return math.degrees(self.angle)

    def _lon_reach(self, abs_lat: str) -> str:
        """Largest longitude difference, in degrees, inside a disc centred at this latitude."""
        if self.angle >= math.pi / 2:
            return "180.0D"
        ratio = f"{sql_number(math.sin(self.angle))} / cos(radians({abs_lat}))"
        clear = f"radians({abs_lat}) < {sql_number(math.pi / 2 - self.angle)}"
        return f"CASE WHEN {clear} THEN degrees(asin({ratio})) ELSE 180.0D END"

    @property
    def _columns(self) -> str:
        """Number of block columns in latitude band ``_band``; any number is correct."""
        h = self.band_degrees
        poleward = f"abs(_band * {sql_number(h)} + {sql_number(h / 2 - 90)}) + {sql_number(h / 2)}"
        fit = f"floor({sql_number(360 / h)} * cos(radians(least(90.0D, {poleward}))))"
        return f"greatest(1L, coalesce({fit}, 1L))"

    def locate(
        self, df: DataFrame, lat: str, lon: str, names: tuple[str, str, str] = ("block", "sub_row", "sub_col")
    ) -> DataFrame:
        """Adds the block and the finest row and column inside it of each point.

        Points without coordinates get block -1.
        """
        kept = df.columns
        return (
            df.selectExpr("*", f"({lat} + 90) / {sql_number(self.band_degrees)} AS _v")
            .selectExpr("*", "floor(_v) AS _band")
            .selectExpr("*", f"{self._columns} AS _n")
            .selectExpr("*", f"({lon} + 180) / (360D / _n) AS _u")
            .selectExpr(
                *kept,
                f"coalesce({_BLOCK.format(column='floor(_u)')}, -1L) AS {names[0]}",
                *[f"least(cast(floor(({p} - floor({p})) * {_FINEST}) AS int), {_FINEST - 1}) AS {name}"
                  for p, name in zip(("_v", "_u"), names[1:])],
            )
        )

    def reach(self, df: DataFrame, lat: str, lon: str) -> DataFrame:
        """Repeats each row for every ``block`` that can hold a point within the radius."""
        kept = df.columns
        band = f"cast(floor(({lat} + 90) / {sql_number(self.band_degrees)}) AS bigint)"
        return (
            df.selectExpr("*", f"{self._lon_reach(f'abs({lat})')} AS _half", f"explode(sequence({band} - 1, {band} + 1)) AS _band")
            .selectExpr("*", f"{self._columns} AS _n")
            .selectExpr(
                "*",
                f"floor(({lon} + 180 - _half) / (360D / _n)) AS _first",
                f"floor(({lon} + 180 + _half) / (360D / _n)) AS _last",
            )
            .selectExpr("*", "explode(sequence(_first, least(_last, _first + _n - 1))) AS _column")
            .selectExpr(*kept, f"coalesce({_BLOCK.format(column='_column')}, -1L) AS block")
        )

    def block_range(self, lat: float) -> tuple[int, int]:
        """First and last block number of the bands a disc centred at this latitude touches."""
        band = math.floor((lat + 90.0) / self.band_degrees)
        return (band - 1) * _ROW_STRIDE, (band + 2) * _ROW_STRIDE - 1


def cell_key(level: int) -> list[str]:
    """Expressions naming the cell of a located point; level 0 is the whole block."""
    if level == 0:
        return ["block"]
    shift = (MAX_LEVEL - level) * LEVEL_BITS
    return ["block", f"shiftright(sub_row, {shift}) AS cell_row", f"shiftright(sub_col, {shift}) AS cell_col"]
