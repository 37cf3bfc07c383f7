"""Column types of every input table; nothing is inferred."""

from __future__ import annotations

# Order of the demographic columns (fixed values).
DEMOGRAPHIC_COLUMNS = (
    "GEOID", "Location", "POP", "Total_Households", "Median_HH_Income",
    "Low_Income_HH", "Low_Income_Rate", "HH_SNAP", "SNAP_Rate",
    "Public_Assistance_HH", "Public_Assistance_Rate",
    "Children_0_17", "Children_0_4", "Children_5_17", "Child_Dependency_Rate",
    "Elderly_65_Plus", "Elderly_65_74", "Elderly_75_Plus", "Elderly_Dependency_Rate",
    "Total_Dependency_Rate", "HH_With_Children", "HH_With_Children_Rate",
    "Single_Parent_HH", "Single_Parent_Rate", "Renter_Occupied", "Renter_Rate",
    "Vacant_Housing_Units", "Vacancy_Rate", "Built_Before_1940", "Old_Housing_Rate",
    "Total_Workers", "Workers_No_Car", "No_Car_Rate", "HH_No_Internet", "No_Internet_Rate",
)


def _demographic_type(name: str) -> str:
    if name in ("GEOID", "Location"):
        return "string"
    return "double" if name.endswith("_Rate") else "bigint"


BOUNDARIES = (
    "GEOID string, STATEFP string, COUNTYFP string, TRACTCE string, BLKGRPCE string, "
    "lat double, lon double, geom_geojson string"
)
DEMOGRAPHICS = ", ".join(f"{name} {_demographic_type(name)}" for name in DEMOGRAPHIC_COLUMNS)
CANDIDATE_SITES = "site_id string, name string, type string, lat double, lon double"
CANDIDATE_POINTS = "site_id string, lat double, lon double"
TRACT_POPULATION = "GEOID string, NAME string, POP bigint"
DATA_DICTIONARY = (
    "Variable_Name string, Category string, Subcategory string, Data_Type string, "
    "Definition string, Optimizer_Use string, Source_Table string"
)
