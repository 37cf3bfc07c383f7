import pytest

from catchment.operators import generate
from catchment.schemas import DEMOGRAPHIC_COLUMNS


def test_candidates_follow_the_stated_mix(spark):
    rows = generate.generate_candidates(spark, 4000, seed=7).collect()
    assert len(rows) == 4006 and [r.site_id for r in rows[-6:]] == [s[0] for s in generate.BASE_SITES]
    free = [r for r in rows if "_rand_" in r.site_id]
    assert 0.27 < len(free) / 4000 < 0.33
    south, north, west, east = generate.METRO_BOX
    assert all(south <= r.lat <= north and west <= r.lon <= east for r in free)
    near = [r for r in rows if "_jitter_" in r.site_id]
    assert all(any(abs(r.lat - b[1]) <= 0.035 and abs(r.lon - b[2]) <= 0.035 for b in generate.BASE_SITES) for r in near)
    assert sum(r.lat for r in free) / len(free) == pytest.approx((south + north) / 2, abs=0.02)


def test_options(spark):
    plain = generate.generate_candidates(spark, 50, box=None, include_base=False).collect()
    assert len(plain) == 50 and all("_jitter_" in r.site_id for r in plain)


def test_same_seed_same_rows_whatever_the_partitions(spark):
    one = generate.scatter_sites(spark.range(300).repartition(1), seed=3).collect()
    many = generate.scatter_sites(spark.range(300).repartition(7), seed=3).collect()
    other = generate.scatter_sites(spark.range(300), seed=4).collect()
    assert sorted(one) == sorted(many) != sorted(other)


def test_demographics_are_drawn_around_the_averages(spark):
    ids = spark.range(4000).selectExpr("concat('29189', lpad(id, 7, '0')) AS geoid")
    df = generate.synthesize_demographics(ids)
    assert df.columns == list(DEMOGRAPHIC_COLUMNS)
    pdf = df.toPandas()
    assert abs(pdf.POP.mean() - 1340) < 20 and abs(pdf.POP.std() - 402) < 20 and pdf.POP.min() >= 100
    assert abs(pdf.Median_HH_Income.mean() - 81441) < 800 and abs(pdf.Median_HH_Income.std() - 15000) < 600
    assert (pdf.Total_Households == (pdf.POP / 2.5).astype(int).clip(lower=40)).all()
    assert (pdf.Workers_No_Car == (pdf.POP * 0.40 * 0.08).astype(int)).all()
    assert set(pdf.Total_Dependency_Rate) == {35.0}
