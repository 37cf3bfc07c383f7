import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from catchment.llm import resampling
from catchment.llm.common import blocks
from hard_rows import SENTENCE, documents, hard_documents, no_documents

A_TO_Z = {i: i + 32 for i in range(65, 91)}


def grams(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(A_TO_Z))
    return words, [" ".join(words[i:i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def plain(docs, target, least=20, percent=5, buckets=10_000):
    """Counts in dictionaries, one n-gram at a time."""
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    s = Counter(bucket(g) for _, text in docs for g in grams(text)[1])
    t = Counter(bucket(g) for text in target for g in grams(text)[1])
    of_docs, of_target = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * of_docs / ((s[b] + 1) * of_target))) for b in s}
    rows = []
    for i, text in docs:
        words, found = grams(text)
        weight = sum(gain[bucket(g)] for g in found)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([i, len(words), len(found), weight, score, None])
    fit = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for rank, r in enumerate(fit[:len(fit) * percent // 100], 1):
        r[5] = rank
    return sorted(map(tuple, rows), key=str)


def got(spark, docs, target, **options):
    target = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id int, text string")
    columns = ("doc_id", "n_words", "n_features", "weight", "score", "rank")
    return sorted((tuple(r[c] for c in columns) for r in resampling.resample(docs, target, **options).collect()), key=str)


def test_against_plain_counts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    target = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    want = plain([(r.doc_id, r.text) for r in docs.collect()], target)
    assert got(spark, docs.repartition(5), target) == want
    assert sum(r[5] is not None for r in want) > 0


@pytest.mark.parametrize("target", [[SENTENCE, None, ""], []])
def test_hard_rows(spark, target):
    docs = hard_documents(spark)
    want = plain([(r.doc_id, r.text) for r in docs.collect()], target, least=1, percent=60)
    assert got(spark, docs, target, least_words=1, percent=60) == want
    assert got(spark, no_documents(spark), target) == []


def test_ties_go_to_the_smaller_id(spark):
    # Ids are the only difference, so the noise decides; equal scores are settled by id.
    texts = [SENTENCE * 2] * 400
    rows = got(spark, documents(spark, texts), [SENTENCE], percent=50)
    assert rows == plain(list(enumerate(texts)), [SENTENCE], percent=50)
    drawn = sorted((r for r in rows if r[5]), key=lambda r: r[5])
    assert [r[5] for r in drawn] == list(range(1, 201))
    assert all((a[4], -a[0]) >= (b[4], -b[0]) for a, b in zip(drawn, drawn[1:]))


def test_texts_of_the_target_come_first(spark):
    texts = [f"common word number{i % 7} and so on " * 8 for i in range(190)] + [SENTENCE * 4] * 10
    rows = got(spark, documents(spark, texts), [SENTENCE])
    assert {r[0] for r in rows if r[5]} == set(range(190, 200))


def test_few_ranges_or_many(spark):
    docs = documents(spark, [f"{SENTENCE} {i % 13}" for i in range(300)])
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "23")
        many = got(spark, docs, [SENTENCE], percent=90)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert many == got(spark, docs, [SENTENCE], percent=90)


TEXTS = ["The quick, brown 日本語 éàü " + "x" * 5000 + " a b c d " + "long" * 30 + " a b c", None, "", "one", "one two", "y" * 9000 + " y"]


def all_grams(most_words):
    for block in blocks(pa.array(TEXTS * 3)):
        yield from resampling.features(block, most_words)[1]


def test_hashes_equal_the_library():
    for part in all_grams(1000):
        raw = [part.raw(i) for i in range(len(part.start))]
        assert [xxhash.xxh64_intdigest(r) for r in raw] == part.xxhash64().tolist()
        assert {len(r) for r in raw} & set(range(32, 200)) and max(map(len, raw)) > 9000


@pytest.mark.parametrize("most_words", [1, 2, 7, 1000])
def test_features_at_the_borders_of_slices(most_words):
    found = Counter(part.raw(i).decode() for part in all_grams(most_words) for i in range(len(part.start)))
    assert found == Counter(g for text in TEXTS * 3 for g in grams(text)[1])


@pytest.mark.parametrize("hashes", [None, "equal", "last"])
def test_table_compares_bytes(hashes):
    """Equal keys, and keys that wrap round the end of the table, keep features apart."""
    for part in all_grams(1000):
        n = len(part.start)
        key = {None: None, "equal": np.zeros(n, np.uint64), "last": np.full(n, (1 << 64) - 1, np.uint64)}[hashes]
        table = resampling.GramTable(part, hashes=key)
        raw = [part.raw(i) for i in range(n)]
        assert len(table.used) == len(set(raw))
        assert [table.bucket[s] for s in table.slot] == [zlib.crc32(r) % 10_000 for r in raw]
        assert [table.count[s] for s in table.slot] == [Counter(raw)[r] for r in raw]
