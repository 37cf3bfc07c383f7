import itertools
import random
import re

import numpy as np
import pytest

from catchment.llm import superminhash as s
from hard_rows import documents, hard_documents, no_documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def plain(texts, percent=85):
    """Size of the set and smallest reachable id of every (id, text)."""
    sets = {i: shingle_set(t) for i, t in texts}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


def cloud(seed, n=260):
    """Copies of one text with up to four changed words, so that similarities lie on both sides of the limit."""
    r = random.Random(seed)
    base = [f"w{r.randrange(400)}" for _ in range(150)]
    texts = []
    for k in range(n):
        w = list(base)
        for _ in range(r.choice((0, 1, 2, 3, 3, 4, 4))):
            w[r.randrange(150)] = f"n{k}x{r.randrange(99)}"
        texts.append(" ".join(w).title() if k % 5 == 0 else " ".join(w))
    return texts + [" ".join(f"o{r.randrange(9000)}" for _ in range(r.randrange(1, 60))) for _ in range(80)]


@pytest.mark.parametrize("rows, shingles", [(1500, 1_500_000), (40, 1_500_000), (1500, 4000)])
def test_a_cloud_of_copies_in_parts_of_any_size(spark, monkeypatch, rows, shingles):
    monkeypatch.setattr(s, "PART_ROWS", rows)
    monkeypatch.setattr(s, "PART_SHINGLES", shingles)
    texts = cloud(rows)
    got = s.near_duplicates(documents(spark, texts).repartition(3)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == plain(list(enumerate(texts)))
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_registered_query_against_all_pairs(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in s.near_duplicates(docs).collect()}
    assert got == plain(texts)


def one_by_one(values, slots):
    """SuperMinHash as published: one element and one rank after the other."""
    least = [float("inf")] * slots
    for value in values:
        order = list(range(slots))
        for j in range(slots):
            draw = int(s.mix(np.array([value ^ s._ROUND[j]], np.uint64))[0])
            pick = j + (draw >> 40) % (slots - j)
            order[j], order[pick] = order[pick], order[j]
            least[order[j]] = min(least[order[j]], j + (draw & ((1 << 40) - 1)) / (1 << 40))
    return least


@pytest.mark.parametrize("n", [1, 2, 7, 60, 500])
def test_stopping_early_changes_nothing(n):
    values = np.random.default_rng(n).integers(1, 1 << 62, n, dtype=np.uint64)
    got = s.superminhash(np.concatenate([values, values[:1]]), np.array([0] * n + [1]), 3)
    assert got[0].tolist() == one_by_one(values, s.SLOTS)
    assert got[1].tolist() == one_by_one(values[:1], s.SLOTS)
    assert np.isinf(got[2]).all()


def test_estimates_vary_less_than_independent_ones():
    random_ = np.random.default_rng(8)
    shares = []
    for _ in range(300):
        a = random_.integers(1, 1 << 62, 60, dtype=np.uint64)
        b = np.concatenate([a[:40], random_.integers(1, 1 << 62, 20, dtype=np.uint64)])
        got = s.superminhash(np.concatenate([a, b]), np.repeat([0, 1], 60), 2)
        shares.append((got[0] == got[1]).mean())
    assert abs(np.mean(shares) - 0.5) < 0.01
    assert np.var(shares) < 0.25 / s.SLOTS


def test_hard_rows(spark):
    docs = hard_documents(spark)
    rows = s.near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    by_id = {}
    for r in rows:
        by_id.setdefault(r["doc_id"], []).append(r)
    assert [len(by_id[2]), by_id[2][0]["component_id"], by_id[2][0]["kept"]] == [2, 1, False]
    for i in (3, 4, 5):
        assert (by_id[i][0]["n_shingles"], by_id[i][0]["component_id"], by_id[i][0]["kept"]) == (0, i, True)
    assert by_id[None][0]["component_id"] is None and by_id[None][0]["kept"]
    assert by_id[6][0]["n_shingles"] == 1 and by_id[7][0]["n_shingles"] > 100_000
    assert s.near_duplicates(no_documents(spark)).count() == 0


def bag(spark, rows, extra="x"):
    return spark.createDataFrame([(extra, i, t, "en") for i, t in rows], "node string, doc_id bigint, text string, first string").repartition(3)


def stays(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


A, B, C, D = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcd")
A2 = A.replace("a59", "other")  # 55 of 57 shingles in common


def test_ids_that_are_repeated(spark):
    rows = [(1, A), (1, A), (5, A), (5, B), (7, C), (7, C)]
    assert stays(s.first_of_groups(bag(spark, rows))) == [(1, A), (5, B), (7, C)]
    labels = sorted((r.doc_id, r.component_id, r.kept) for r in s.near_duplicates(bag(spark, rows)).collect())
    assert labels == [(1, 1, True), (1, 1, True), (5, 1, False), (5, 5, True), (7, 7, True), (7, 7, True)]


def test_texts_under_one_id_lend_each_other_nothing(spark):
    rows = [(3, D), (4, B), (4, A), (9, A2), (8, D), (2, B + " tail"), (6, "")]
    labels = {(r.doc_id, r.n_shingles): r.component_id for r in s.near_duplicates(bag(spark, rows)).collect()}
    by_text = sorted((r.doc_id, r.component_id) for r in s.near_duplicates(bag(spark, rows)).collect())
    assert by_text == [(2, 2), (3, 3), (4, 2), (4, 4), (6, 6), (8, 3), (9, 4)] and len(labels) == 6
    assert stays(s.first_of_groups(bag(spark, rows))) == sorted([(3, D), (4, A), (2, B + " tail"), (6, "")], key=str)


def test_rows_without_an_id(spark):
    rows = [(None, A), (None, A2), (None, B), (None, B), (3, B), (None, C.upper()), (None, None), (None, " "), (None, None), (5, None), (5, None)]
    assert stays(s.first_of_groups(bag(spark, rows)))[0] == (3, B)
    kept = stays(s.first_of_groups(bag(spark, rows)))
    assert len(kept) == 1 + 1 + 1 + 5 and sum(t in (A, A2) for _, t in kept) == 1 and (None, C.upper()) in kept
    labels = [(r.n_shingles, r.component_id, r.kept) for r in s.near_duplicates(bag(spark, rows)).where("doc_id IS NULL").collect()]
    assert sorted(labels, key=str) == sorted([(56, None, True)] * 3 + [(56, 3, False)] * 2 + [(0, None, True)] * 3, key=str)


def test_unique_ids_keep_columns_and_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = s.first_of_groups(docs)
    assert kept.schema == docs.schema
    wanted = {r.doc_id for r in s.near_duplicates(docs).where("kept").collect()}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(wanted)
    hard = hard_documents(spark)
    assert s.first_of_groups(hard).columns == hard.columns and s.first_of_groups(no_documents(spark)).count() == 0
