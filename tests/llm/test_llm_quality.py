import re
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from catchment.llm import quality_trees as q
from hard_rows import hard_documents, no_documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    w = WORD.findall(text or "")
    windows = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    repeated = {i + k for i in range(len(w) - 2) if windows[tuple(w[i:i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(repeated)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab #é\n\t🙂", max_size=40)), min_size=1, max_size=6), st.integers(1, 60))
def test_statistics(rows, most):
    got = []
    for block in q.blocks(pa.array(rows, pa.string()), most):
        s = q.statistics(block)
        got += list(zip(*[s[k].tolist() for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]))
        assert np.isfinite(q.features(s)).all()
    assert got == [plain(t) for t in rows]


def test_trees_learn_and_stay_monotonic():
    random = np.random.default_rng(1)
    x = random.normal(size=(4000, 3))
    y = ((x[:, 0] - 0.5 * x[:, 1] + np.sin(3 * x[:, 2]) + 0.3 * random.normal(size=4000)) > 0).astype(float)
    trees = q.boost(x, y, [1, -1, 0])
    assert ((trees.score(x) > 0.5) == (y > 0)).mean() > 0.9
    for feature, direction in ((0, 1), (1, -1)):
        for row in x[:60]:
            line = np.tile(row, (50, 1))
            line[:, feature] = np.linspace(-3, 3, 50)
            assert (direction * np.diff(trees.score(line)) >= -1e-12).all()


def test_flat_trees_equal_walking_them():
    random = np.random.default_rng(2)
    x = random.normal(size=(600, 4))
    trees = q.boost(x, (x[:, 0] * x[:, 1] > 0).astype(float), [0] * 4)
    for row, score in zip(x[:80], trees.score(x[:80])):
        total = trees.base
        for t in range(len(trees.feature)):
            node = 0
            for _ in range(q.DEPTH):
                node = 2 * node + (2 if row[trees.feature[t, node]] > trees.threshold[t, node] else 1)
            total += trees.value[t, node]
        assert abs(score - 1 / (1 + np.exp(-total))) < 1e-9


def test_training_needs_both_kinds():
    assert q.train(np.zeros((5, 3)), np.ones(5, int)) is None


def test_registered_query_against_plain_python(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = q.judge_quality(docs, labels).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = plain(texts[r["doc_id"]])
        assert tuple(r[1:6]) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r["base_failed"] and r["kept"])
    quality = {r["doc_id"]: r["quality"] for r in labels.collect()}
    passed = [r for r in rows if not r["base_failed"] and r["doc_id"] in quality]
    right = [r["kept"] == bool(quality[r["doc_id"]]) for r in passed]
    assert sum(right) >= 0.95 * len(right)


def test_hard_rows(spark):
    docs = hard_documents(spark)
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (4, None), (99, 0)], "doc_id bigint, quality int")
    rows = q.judge_quality(docs, labels).collect()
    assert len(rows) == docs.count()
    empty = [r for r in rows if r["doc_id"] in (3, 4, 5)]
    assert all(r["n_words"] == 0 and r["base_failed"] and not r["kept"] for r in empty)
    without = q.judge_quality(docs, labels.limit(0)).collect()
    assert all(r["score"] is None and r["kept"] == (not r["base_failed"]) for r in without)
    assert q.judge_quality(no_documents(spark), labels).count() == 0
