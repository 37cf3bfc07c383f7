import hashlib
import random
import re
import zlib
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from catchment.llm import periodic_runs
from catchment.llm.queries import QUERIES
from hard_rows import documents, hard_documents, no_documents


def plain_runs(w):
    """Every period in turn, every stretch in which words that far apart are equal."""
    found = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            start, end = i, j + q
            if end - start >= max(6, 4 * q):
                if not any(q % d == 0 and w[start:end - d] == w[start + d:end] for d in range(1, q)):
                    found.append((start, end - start, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text, written):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if written and h % 10 == 0 and n:
        g = h // 10
        a, old = g % n, list(words)
        p = 1 + (n - a) // (3 + g % 8)
        for i in range(a, n):
            words[i] = old[a + (i - a) % p]
    runs = plain_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, n, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from("ab"), max_size=60), max_size=4), st.sampled_from([1, 2, 7, 64, 1 << 15]))
def test_two_letters(texts, append):
    assert periodic_runs.word_runs(texts, append) == [plain_runs(w) for w in texts]


def test_pieces_repeated():
    random.seed(5)
    n = 0
    for _ in range(400):
        texts = []
        for _ in range(3):
            w = []
            while len(w) < 150:
                piece = random.choices("abc", k=random.randint(1, 20))
                w += (piece * random.randint(1, 9))[:random.randint(1, 90)]
            texts.append(w)
        want = [plain_runs(w) for w in texts]
        assert periodic_runs.word_runs(texts, random.choice([5, 33, 4096])) == want
        n += sum(map(len, want))
    assert n > 1000


@pytest.mark.parametrize("period", [1, 2, 3, 31, 32, 33, 1000])
def test_long_runs_between_other_words(period):
    before, after = [f"b{i}" for i in range(777)], [f"a{i}" for i in range(501)]
    piece = [f"p{i}" for i in range(period)]
    for times in (4, 5, 17):
        run = (777, max(6, times * period), period)
        w = before + (piece * (times + 6))[:run[1]] + after
        assert periodic_runs.word_runs([w, w[::-1], w], 1000)[0] == [run]


def test_no_run_below_four_periods_or_across_texts():
    piece = [f"p{i}" for i in range(10)]
    assert periodic_runs.word_runs([(piece * 4)[:39], piece * 2, piece * 2, ["a"] * 5]) == [[]] * 4
    assert periodic_runs.word_runs([]) == [] and periodic_runs.word_runs([[]]) == [[]]


def test_squares_do_not_outnumber_words():
    """Only one distance a catcher is reported, even where all words are equal."""
    catchers = periodic_runs.SquareCatchers(5000)
    import numpy as np

    catchers.append(np.zeros(5000, np.int64))
    assert catchers.runs() == [(0, 5000, 1)]
    assert sum(len(s[0]) for level in catchers.squares for s in level) <= 2 * 5000


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("written", [False, True])
def test_hard_rows(spark, written):
    docs = hard_documents(spark)
    short = docs.where("length(text) < 20000 OR text IS NULL")
    want = sorted((plain_row(r.doc_id, r.text, written) for r in short.collect()), key=str)
    assert rows(periodic_runs.find_runs(short, written=written)) == want
    assert periodic_runs.find_runs(docs, written=written).count() == docs.count()
    assert rows(periodic_runs.find_runs(no_documents(spark))) == []


def test_query_against_plain_search(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    got = {r.doc_id: tuple(r) for r in QUERIES["op12_periodic_runs"](spark, sf_dir).collect()}
    assert len(got) == len(docs)
    few = [r for r in docs if len(r.text or "") < 6000]
    assert len(few) > len(docs) / 2
    assert [got[r.doc_id] for r in few] == [plain_row(r.doc_id, r.text, True) for r in few]
    assert sum(r[2] for r in got.values()) > len(docs) / 20


def test_ties_go_to_the_first_run(spark):
    text = "z " + "a b " * 4 + "x " + "c d " * 4 + "y " + "e f g " * 4
    (row,) = periodic_runs.find_runs(documents(spark, [text])).collect()
    assert (row.n_runs, row.start, row.length, row.period, row.exponent_milli) == (3, 1, 8, 2, 4000)


def test_collapsed_texts(spark):
    docs = documents(spark, ["say  ha ha ha ha ha ha ha now", "nothing\there  repeats", None, ""])
    out = periodic_runs.collapse_text(docs)
    assert out.schema == docs.schema
    assert [r.text for r in out.orderBy("doc_id").collect()] == ["say ha now", "nothing\there  repeats", None, ""]
    hard = hard_documents(spark)
    assert periodic_runs.collapse_text(hard).count() == hard.count()
