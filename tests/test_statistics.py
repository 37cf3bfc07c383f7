import random
import statistics

import pytest

from catchment.operators.statistics import exact_median, exact_medians


@pytest.mark.parametrize("values", [
    [1], [1, 2], [3, 1, 2], [5, 5, 5, 5], [1, 1, 1, 9], [0.5, -2.0, 7.25, 3.0],
    [random.Random(1).randrange(10**9) for _ in range(5001)],
    [random.Random(2).gauss(0, 1) for _ in range(4000)],
    [7] * 3000 + list(range(2000)),
])
def test_equals_the_plain_median(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double").repartition(5)
    assert exact_median(df, "v").first()[0] == statistics.median(values)


def test_wide_table(spark):
    df = spark.range(200_001).selectExpr("cast(pmod(id * 7919, 200001) AS double) AS v")
    assert exact_median(df, "v").first()[0] == 100_000.0


def test_no_values(spark):
    df = spark.createDataFrame([(None,)], "v double")
    assert exact_median(df, "v").collect()[0][0] is None
    assert exact_median(df.where("v > 0"), "v").collect()[0][0] is None


def test_a_bracket_that_misses_is_widened(spark):
    from catchment.operators.statistics import median_row

    df = spark.range(1001).selectExpr("cast(id AS double) AS v")
    assert median_row(df, "v", [0.0, 3.0, 4.0, 1000.0], 1001).first()[0] == 500.0
    assert median_row(df, "v", [0.0, 990.0, 991.0, 1000.0], 1001).first()[0] == 500.0


def test_two_passes(spark, sf_dir):
    from catchment.plans import inputs

    seen = spark.sparkContext.accumulator(0)
    rows = inputs.counts(spark, sf_dir).rdd.map(lambda r: (seen.add(1), (float(r.Median_HH_Income),))[1]).toDF("v double")
    median = exact_median(rows, "v").first()[0]
    assert median is not None and seen.value <= 2 * inputs.counts(spark, sf_dir).count()


def test_columns_share_both_passes(spark):
    seen = spark.sparkContext.accumulator(0)
    rng = random.Random(3)
    rows = [(rng.randrange(10**6), rng.gauss(0, 1), None if i % 3 else float(i), None) for i in range(3001)]
    df = spark.createDataFrame(rows, "a bigint, b double, c double, d double").repartition(3)
    counted = df.rdd.map(lambda r: (seen.add(1), tuple(r))[1]).toDF(df.schema)
    got = exact_medians(counted, {"x": "a", "y": "b", "z": "c", "none": "d"}).first()
    want = [statistics.median([v for v in column if v is not None]) for column in list(zip(*rows))[:3]]
    assert list(got) == [*want, None] and got.asDict().keys() == {"x", "y", "z", "none"}
    assert seen.value <= 2 * len(rows)
