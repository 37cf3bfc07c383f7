"""The two whole jobs: answering coverage requests, and the tables of a static map."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame

from catchment.functions.geometry import (
    first_outer_ring,
    usable_ring,
    with_parts,
    with_projected_centroid,
)
from catchment.operators.areas import DEFAULT_SITE_TYPES, enrich, merge_population
from catchment.operators.coverage import CoverageRun, run_coverage
from catchment.operators.reports import describe_areas
from catchment.sources.cache import FrameCache


def prepare_areas(
    boundaries: DataFrame, city: DataFrame, county: DataFrame, geojson: str | None = "geom_geojson"
) -> DataFrame:
    """Boundaries with population, the county figure first, then the city figure, else 0.

    With ``geojson`` the first outer ring is added as ``polygon`` and areas without
    one are left out; without it no area depends on its geometry.
    """
    merged = merge_population(boundaries, [county, city])
    if geojson is None:
        return merged
    parsed = with_parts(merged, geojson, "_parts")
    return parsed.withColumn("polygon", first_outer_ring("_parts")).drop("_parts").where(usable_ring("polygon"))


class CoverageService:
    """Keeps the prepared areas and the sites between requests.

    Demand covers all areas, also those whose geometry cannot be drawn, unless
    ``require_geometry`` is set.
    """

    def __init__(
        self, boundaries: DataFrame, city: DataFrame, county: DataFrame, sites: DataFrame, require_geometry: bool = False
    ) -> None:
        self._inputs = boundaries, city, county
        self._sites = sites
        self._geojson = "geom_geojson" if require_geometry else None
        self._cache = FrameCache()

    def block_groups(self) -> DataFrame:
        """``geoid, lat, lon, population, polygon`` of the areas that can be drawn."""
        return prepare_areas(*self._inputs).select("geoid", "lat", "lon", "population", "polygon")

    def candidates(self) -> DataFrame:
        return self._cache.get("sites", lambda: self._sites.select("site_id", "name", "type", "lat", "lon"))

    def optimize(
        self,
        affected: DataFrame | Iterable[str],
        radius_miles: float = 2.0,
        k: int = 5,
        site_types: Sequence[str] = DEFAULT_SITE_TYPES,
    ) -> CoverageRun:
        demand = self._cache.get(
            "demand", lambda: prepare_areas(*self._inputs, self._geojson).select("geoid", "lat", "lon", "population")
        )
        return run_coverage(demand, self.candidates(), affected, radius_miles, k, site_types)

    def clear_cache(self) -> None:
        self._cache.clear()


def map_tables(boundaries: DataFrame, demographics: DataFrame, geojson: str = "geom_geojson", zone: int = 15) -> DataFrame:
    """Areas with projected centroid, all demographics at hand and a descriptive text."""
    placed = with_projected_centroid(with_parts(boundaries, geojson, "_parts"), "_parts", zone=zone).drop("_parts")
    named = demographics.withColumnRenamed("GEOID", "geoid")
    return describe_areas(enrich(placed, named), "geoid")
