import numpy as np
import pytest

from catchment.llm import subspace_join as s

SCHEMA = "vec_id bigint, embedding array<float>, label int, n bigint, root string, block int, copies string"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if x is None else [None if v is None else float(v) for v in x], None, None, None, None, None) for i, x in rows], SCHEMA)


def plain(ids, x):
    x = np.asarray(x, np.float32).astype(float)
    cosine = x @ x.T / np.outer(*[np.linalg.norm(x, axis=1)] * 2)
    near = cosine >= 0.95
    label = np.array(ids)
    while True:
        new = np.array([label[near[k]].min() for k in range(len(ids))])
        if (new == label).all():
            return {i: (int(near[k].sum()) - 1, int(label[k])) for k, i in enumerate(ids)}
        label = new


def groups(dimension, seed):
    """Dense groups around the limit, pairs just inside and outside it, and scattered vectors."""
    r = np.random.default_rng(seed)
    center = r.normal(size=(6, dimension))
    spread = 0.16 / np.sqrt(dimension) * np.linalg.norm(center, axis=1)[:, None, None]
    close = (center[:, None] + spread * r.normal(size=(6, 60, dimension))).reshape(-1, dimension)
    a = r.normal(size=(120, dimension))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = r.normal(size=a.shape)
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    cosine = 0.95 + np.linspace(-0.01, 0.01, 120)[:, None]
    pairs = np.concatenate([a, 3 * (cosine * a + np.sqrt(1 - cosine**2) * b)])
    return np.concatenate([close, pairs, r.normal(size=(100, dimension)), close[:5]])


@pytest.mark.parametrize("dimension, part", [(64, 4096), (64, 50), (20, 4096), (3, 30), (2, 4096)])
def test_against_all_pairs(spark, monkeypatch, dimension, part):
    monkeypatch.setattr(s, "PART", part)
    x = groups(dimension, dimension)
    ids = np.random.default_rng(1).permutation(len(x)).tolist()
    rows = s.link_embeddings(frame(spark, list(zip(ids, x))).repartition(4)).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in rows} == plain(ids, x)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in rows)


def test_registered_query_against_all_pairs(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    source = table.orderBy("vec_id").collect()
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in s.link_embeddings(table).collect()}
    assert got == plain([r["vec_id"] for r in source], [r["embedding"] for r in source])


def test_hard_rows(spark):
    ok = [1.0] * 16
    rows = [(1, ok), (2, [2.0] * 16), (2, [2.0] * 16), (3, None), (4, []), (5, [0.0] * 16), (6, [float("nan")] + ok[1:]),
            (7, [None] + ok[1:]), (8, [float("inf")] + ok[1:]), (None, ok), (9, [1.0] * 8), (10, [-1.0] * 16)]
    got = s.link_embeddings(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    seen = {}
    for r in got:
        seen.setdefault(r["vec_id"], []).append((r["n_links"], r["component_id"], r["kept"]))
    assert seen.pop(1) == [(2, 1, True)] and seen.pop(2) == [(2, 1, False)] * 2
    assert seen.pop(None) == [(0, None, True)]
    assert seen == {i: [(0, i, True)] for i in range(3, 11)}
    assert s.link_embeddings(frame(spark, [])).count() == 0


def test_every_close_pair_meets_the_budget_of_a_block():
    r = np.random.default_rng(5)
    space = s.Space(64, 0.95)
    x = r.normal(size=(2000, 64))
    y = x + 0.03 * np.linalg.norm(x, axis=1, keepdims=True) * r.normal(size=x.shape)
    cosine = (x * y).sum(1) / np.linalg.norm(x, axis=1) / np.linalg.norm(y, axis=1)
    met = (space.parts(space.rotated(x) - space.rotated(y)) <= space.budget).any(1)
    assert met[cosine >= 0.95].all() and (cosine >= 0.95).sum() > 100


def test_double_components_keep_their_precision(spark):
    rows = []
    for i, cosine in ((1, 0.95 - 1e-12), (3, 0.95 + 1e-12)):
        rows += [(i, [float(i), 0.0]), (i + 1, [cosine * i, (1 - cosine**2) ** 0.5 * i])]
    for i, linked in ((1, 0), (3, 1)):
        two = spark.createDataFrame([r for r in rows if r[0] in (i, i + 1)], "vec_id bigint, embedding array<double>")
        assert {r["n_links"] for r in s.link_embeddings(two).collect()} == {linked}
