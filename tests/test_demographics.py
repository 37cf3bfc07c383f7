import math
import random

import numpy as np
import pandas as pd
import pytest

from catchment.operators import demographics
from catchment.schemas import DEMOGRAPHIC_COLUMNS

COUNTS = ["POP", "Total_Households", "Median_HH_Income", "Low_Income_HH", "HH_SNAP", "Public_Assistance_HH",
          "Total_Housing_Units", "Renter_Occupied", "Vacant_Housing_Units", "Total_Workers", "Workers_No_Car",
          "HH_No_Internet", "HH_With_Children", "Single_Parent_HH"]


def counts(seed=1, n=400):
    rng = random.Random(seed)
    rows = [[f"2918900{i:05d}"] + [rng.choice([0, rng.randrange(1, 900)]) for _ in COUNTS] for i in range(n)]
    return pd.DataFrame(rows, columns=["GEOID", *COUNTS])


def rate(n, d):
    """Two-decimal percentage as pandas computes it, with 0 in place of infinities and gaps."""
    with np.errstate(all="ignore"):
        return (n / d * 100).replace([np.inf, -np.inf], np.nan).fillna(0).round(2)


def test_estimate_equals_pandas(spark):
    pdf = counts()
    got = demographics.demographic_table(spark.createDataFrame(pdf), "Somewhere", "estimate").toPandas()
    assert list(got.columns) == list(DEMOGRAPHIC_COLUMNS)
    got = got.sort_values("GEOID").reset_index(drop=True)
    for name, n, d in demographics.COUNT_RATES:
        assert (got[name] == rate(pdf[n], pdf.eval(d))).all(), name
    children, elderly = (pdf.POP * 0.2).astype(int), (pdf.POP * 0.15).astype(int)
    assert (got.Children_0_17 == children).all() and (got.Elderly_65_Plus == elderly).all()
    assert (got.Children_0_4 == (children * 0.25).astype(int)).all()
    assert (got.Children_5_17 == (children * 0.75).astype(int)).all()
    assert (got.Elderly_65_74 == (elderly * 0.6).astype(int)).all()
    assert (got.Elderly_75_Plus == (elderly * 0.4).astype(int)).all()
    assert (got.Total_Dependency_Rate == (rate(children, pdf.POP) + rate(elderly, pdf.POP)).round(2)).all()
    assert set(got.Location) == {"Block Group, Somewhere"}


def test_cells_mode(spark):
    row = {c: 10 for c in COUNTS} | {"GEOID": "1", "POP": 300, "Children_0_17": 50, "Children_0_4": None,
           "Male_5_9": 1, "Female_5_9": 2, "Male_10_14": 3, "Female_10_14": 4, "Male_15_17": 5, "Female_15_17": 6,
           "Male_65_74": 7, "Female_65_74": 8, "Male_75_plus": 9, "Female_75_plus": None,
           "Median_Year_Built": 1939, "Units_Before_1940": 1, "Housing_Age_Universe": 3}
    schema = ", ".join(f"{k} {'string' if k == 'GEOID' else 'bigint'}" for k in row)
    got = demographics.demographic_table(spark.createDataFrame([tuple(row.values())], schema), "X", "cells").first()
    assert (got.Children_0_4, got.Children_5_17) == (0, 21)
    assert (got.Elderly_65_74, got.Elderly_75_Plus, got.Elderly_65_Plus) == (15, 0, 15)
    assert (got.Child_Dependency_Rate, got.Elderly_Dependency_Rate, got.Total_Dependency_Rate) == (16.67, 5.0, 21.67)
    assert (got.Built_Before_1940, got.Old_Housing_Rate, got.Renter_Rate) == (1, 33.33, 0.0)


def test_known_elderly_turns_gaps_into_zero(spark):
    pdf = counts(2, 50)
    frame = spark.createDataFrame(pdf).selectExpr("*", "cast(NULL AS bigint) AS Pop_65_Plus")
    got = demographics.derive_metrics(frame, "estimate_known_elderly").first()
    assert (got.Elderly_65_Plus, got.Elderly_65_74, got.Elderly_Dependency_Rate) == (0, 0, 0.0)


def test_zero_denominators_and_units(spark):
    pdf = pd.DataFrame([["1"] + [0] * len(COUNTS), ["2"] + [0] * len(COUNTS)], columns=["GEOID", *COUNTS])
    pdf.loc[1, "Low_Income_HH"] = 5
    frame = spark.createDataFrame(pdf)
    zero = demographics.derive_metrics(frame, "estimate").orderBy("GEOID").collect()
    assert [r.Low_Income_Rate for r in zero] == [0.0, 0.0]
    kept = demographics.derive_metrics(frame, "estimate", on_zero="inf").orderBy("GEOID").collect()
    assert kept[0].Low_Income_Rate == 0.0 and math.isinf(kept[1].Low_Income_Rate)
    pdf.loc[1, ["Total_Households", "Low_Income_HH"]] = (8, 1)
    share = demographics.derive_metrics(spark.createDataFrame(pdf), "estimate", unit="fraction").orderBy("GEOID").collect()
    assert share[1].Low_Income_Rate == 0.125
    with pytest.raises(ValueError):
        demographics.derive_metrics(frame, "guess")


def test_rounding_is_half_to_even(spark):
    df = spark.createDataFrame([(0.125, 2.5), (0.375, 3.5), (None, None)], "A_Rate double, n double")
    rows = demographics.round_numbers(df).collect()
    assert [(r.A_Rate, r.n) for r in rows] == [(0.12, 2), (0.38, 4), (None, None)]


def test_missing_cells_raise_unless_named_as_absent(spark):
    cells = {c: 3 for cells in demographics.AGE_CELLS.values() for c in cells}
    counts = {c: 8 for n in demographics.COUNT_RATES for c in n[1:] if c.isidentifier()}
    row = {"GEOID": "a", "POP": 100, "Children_0_17": 30, "Children_0_4": 4, "Median_Year_Built": 1930,
           "Total_Housing_Units": 9, "Vacant_Housing_Units": 1, "Units_Before_1940": 1, "Housing_Age_Universe": 4} | counts | cells
    whole = demographics.derive_metrics(spark.createDataFrame([row]), "cells").first()
    assert (whole.Children_5_17, whole.Elderly_65_74, whole.Old_Housing_Rate) == (18, 6, 25.0)
    for gone in ("Male_65_74", "Units_Before_1940"):
        frame = spark.createDataFrame([{k: v for k, v in row.items() if k != gone}])
        with pytest.raises(ValueError, match=gone):
            demographics.derive_metrics(frame, "cells")
    less = demographics.derive_metrics(frame, "cells", absent=["Units_Before_1940"]).first()
    assert less.Old_Housing_Rate == 0.0 and less.Elderly_65_74 == 6
    part = spark.createDataFrame([{k: v for k, v in row.items() if k != "Male_65_74"}])
    assert demographics.derive_metrics(part, "cells", absent=["Male_65_74"]).first().Elderly_65_74 == 3
