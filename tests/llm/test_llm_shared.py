import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from catchment.llm.common import blocks, distinct_in_rows, shingles, span_hashes, words
from catchment.llm.components import components, union_find

WORD = re.compile(r"[^\x20\x09-\x0D]+")
texts = st.lists(st.one_of(st.none(), st.text(alphabet="ab \t\nÄé🙂", max_size=30)), max_size=8)


@settings(max_examples=60, deadline=None)
@given(texts, st.integers(1, 40))
def test_words_of_blocks(rows, most):
    seen = []
    for block in blocks(pa.array(rows, pa.string()), most):
        spans = words(block)
        for i in range(block.n):
            own = spans.row == i
            seen.append([block.data[a:b].tobytes().decode() for a, b in zip(spans.start[own], spans.end[own])])
    assert seen == [WORD.findall(t or "") for t in rows]


@settings(max_examples=60, deadline=None)
@given(texts)
def test_equal_words_and_only_those_have_equal_hashes(rows):
    named = {}
    for block in blocks(pa.array(rows, pa.string()), 16):
        spans = words(block)
        for a, b, h in zip(spans.start, spans.end, span_hashes(block, spans).tolist()):
            named.setdefault(block.data[a:b].tobytes(), set()).add(h)
    assert all(len(h) == 1 for h in named.values())
    assert len(set().union(*named.values())) == len(named) if named else True


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingle_set(text):
    w = WORD.findall(lower(text))
    return {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.none(), st.lists(st.sampled_from("a A b c".split()), max_size=14).map(" ".join)), min_size=1, max_size=8))
def test_shingle_sets(rows):
    sets, at = [], 0
    for block in blocks(pa.array(rows, pa.string()), 20):
        value, row, _ = shingles(block)
        value, row = distinct_in_rows(value, row)
        sets += [set(value[row == i].tolist()) for i in range(block.n)]
    truth = [shingle_set(t) for t in rows]
    assert [len(s) for s in sets] == [len(s) for s in truth]
    for a, x in zip(sets, truth):
        for b, y in zip(sets, truth):
            assert len(a & b) == len(x & y)


def plain_components(pairs):
    up = {}

    def root(i):
        up.setdefault(i, i)
        while up[i] != i:
            i = up[i]
        return i

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in up}


def test_union_find():
    u, v = np.array([5, 9, 7]), np.array([3, 5, 8])
    assert dict(zip(*map(np.ndarray.tolist, union_find(u, v)))) == {3: 3, 5: 3, 9: 3, 7: 7, 8: 7}


def test_components_of_chains_stars_and_loops(spark):
    random.seed(4)
    pairs = [(k, k + 1) for k in range(100, 160)] + [(500, k) for k in range(501, 700)]
    pairs += [(random.randrange(1000, 1300), random.randrange(1000, 1300)) for _ in range(160)] + [(7, 7), (8, 9), (9, 8), (8, 9)]
    random.shuffle(pairs)
    df = spark.createDataFrame(pairs, "u bigint, v bigint").repartition(5)
    got = {r["id"]: r["component"] for r in components(df).collect()}
    assert got == plain_components([p for p in pairs if p[0] != p[1]])


def test_no_links(spark):
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_a_hub_is_spread_over_tasks(spark):
    from pyspark.sql import functions as F

    from catchment.llm import components as c
    from catchment.llm.common import with_key

    star = spark.range(1, 200_001, 1, 8).selectExpr("id AS u", "0L AS v")
    both = star.unionAll(star.selectExpr("v AS u", "u AS v"))
    met = with_key(both, c._least(both), "u", total=400_000)
    sizes = [r["count"] for r in met.where("u = 0").groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) >= 4 and max(sizes) <= 60_000
    assert met.where("u = 0 AND m = 1 OR u > 0 AND m = 0").count() == 400_000
    got = c.components(star.unionAll(spark.range(1, 3000).selectExpr("id + 1000000 AS u", "id + 1000001 AS v")))
    assert got.groupBy("component").count().where("component = 0").first()["count"] == 200_001
    assert got.where("component = 1000001").count() == 3000


@pytest.mark.parametrize("how", ["inner", "left"])
def test_hot_and_other_keys(spark, how):
    from catchment.llm.common import with_key

    rows = spark.range(6000).selectExpr("CASE WHEN id < 3000 THEN -1 WHEN id % 7 = 0 THEN NULL ELSE id END AS k", "id")
    table = spark.range(4000).selectExpr("id AS k", "1L AS n", "id * 2 AS x").unionAll(spark.sql("SELECT -1L, 3000L, NULL"))
    got = sorted((r.id, r.x) for r in with_key(rows, table, "k", how).collect() if r.x is not None)
    assert got == [(i, 2 * i) for i in range(3000, 4000) if i % 7]
    assert with_key(rows, table, "k", how).count() == (6000 if how == "left" else 3000 + len(got))
