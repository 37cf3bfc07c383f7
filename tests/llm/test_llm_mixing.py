from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from catchment.llm import mixing
from hard_rows import hard_documents, no_documents


def filled(sizes, weights, most):
    """Clamping and resharing until nothing is above its cap, in exact fractions."""
    total, capped = sum(sizes), set()
    while True:
        rest = total - sum(most * sizes[i] for i in capped)
        weight = sum(w for i, w in enumerate(weights) if i not in capped)
        level = {i: Fraction(rest * w, weight) for i, w in enumerate(weights) if i not in capped}
        over = {i for i, t in level.items() if t > most * sizes[i]}
        if not over:
            return [most * sizes[i] if i in capped else level[i] for i in range(len(sizes))]
        capped |= over


def test_targets(spark):
    @settings(max_examples=25, deadline=None)
    @given(st.lists(st.integers(0, 60), min_size=1, max_size=9), st.integers(1, 4))
    def check(sizes, most):
        if not sum(sizes):
            return
        totals = spark.createDataFrame([(f"s{i}", n) for i, n in enumerate(sizes)], "source string, source_size bigint")
        got = {r["source"]: r["target"] for r in mixing.targets(totals, (5, 2, 1), most).collect()}
        want = filled(sizes, [(5, 2, 1)[i % 3] for i in range(len(sizes))], most)
        assert [got[f"s{i}"] for i in range(len(sizes))] == pytest.approx([float(x) for x in want])

    check()


def test_null_is_the_last_source(spark):
    totals = spark.createDataFrame([(None, 10), ("b", 10), ("B", 10), ("é", 10)], "source string, source_size bigint")
    rows = mixing.targets(totals).collect()
    assert {r["source"]: r["weight"] for r in rows} == {"B": 5, "b": 2, "é": 1, None: 5}


def test_very_many_sources(spark):
    """200,000 sources of which some take all they may; sums of sizes times weights pass 64 bits."""
    n, big = 200_000, 4_000_000_000_000
    totals = spark.range(n).selectExpr(
        "lpad(cast(id AS string), 7, '0') AS source", f"CASE WHEN id % 1000 = 0 THEN {big} ELSE 1 + id % 50 END AS source_size")
    got = mixing.targets(totals)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    rows = {r["source"]: r["target"] for r in got.collect()}
    sizes = [big if i % 1000 == 0 else 1 + i % 50 for i in range(n)]
    weights = [(5, 2, 1)[i % 3] for i in range(n)]
    order = sorted(range(n), key=lambda i: sizes[i] / weights[i])
    rest, weight = sum(sizes), sum(weights)
    for i in order:
        if weights[i] * rest <= 3 * sizes[i] * weight:
            break
        rest, weight = rest - 3 * sizes[i], weight - weights[i]
    for i in range(n):
        want = min(3 * sizes[i], float(Fraction(weights[i] * rest, weight)))
        assert rows[f"{i:07d}"] == pytest.approx(want)


def test_taken_words(spark, sf_dir):
    rows = mixing.mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()
    again = mixing.mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(7)).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    by_source = {}
    for r in rows:
        assert 0 <= r["taken"] <= 3 * r["size"]
        by_source.setdefault(r["source"], []).append(r)
    for own in by_source.values():
        assert sum(r["size"] for r in own) == own[0]["source_size"]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 1


@pytest.mark.parametrize("most", [0, 100_000])
def test_hard_rows(spark, monkeypatch, most):
    monkeypatch.setattr(mixing, "MOST_BROADCAST", most)  # 0: the salted join
    docs = hard_documents(spark)
    rows = mixing.mix_sources(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        if r["doc_id"] in (3, 4, 5):
            assert (r["size"], r["taken"]) == (0, 0)
    assert sum(r["taken"] for r in rows) == pytest.approx(sum(r["size"] for r in rows), abs=6)
    repeated = mixing.repeat_rows(docs)
    assert repeated.schema == docs.schema
    assert mixing.mix_sources(no_documents(spark)).count() == 0 and mixing.repeat_rows(no_documents(spark)).count() == 0


def test_repeated_rows_follow_the_mix(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    taken = {r["doc_id"]: r for r in mixing.mix_sources(docs).collect()}
    counts = {r["doc_id"]: r["count"] for r in mixing.repeat_rows(docs).groupBy("doc_id").count().collect()}
    for i, r in taken.items():
        assert abs(counts.get(i, 0) * r["size"] - r["taken"]) <= r["size"] / 2
    assert docs.schema == mixing.repeat_rows(docs).schema
