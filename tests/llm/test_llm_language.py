import zlib

import pytest

from catchment.llm import language
from hard_rows import hard_documents, no_documents


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet")
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    rows = language.identify_languages(docs).collect()
    assert len(rows) == len(truth)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    unseen = [r for r in rows if r["held_out"] and truth[r["doc_id"]]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in unseen) >= 0.97 * len(unseen)
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert sum(r["rejected"] for r in rows) <= 0.01 * len(rows)


def plain_logits(text, table, bias):
    """One subword after the other: fold the bytes, hash each run of them, add up its numbers."""
    fold = [b | 0x20 if chr(b).isascii() and chr(b).isalpha() else 0x20 if b < 128 else b for b in text.encode()]
    total, n = [0.0] * len(bias), 0
    for width in (2, 3, 4):
        for i in range(len(fold) - width + 1):
            own = fold[i:i + width]
            if own == [0x20] * width:
                continue
            code = sum(b << 8 * k for k, b in enumerate(own))
            bucket = (code * 0x9E3779B97F4A7C15 % (1 << 64) >> 48) % (language.BUCKETS - 1) + 1
            total = [t + float(line[bucket]) for t, line in zip(total, table)]
            n += 1
    return [t / max(n, 1) + b for t, b in zip(total, bias)]


def test_scores_against_plain_sums(spark, sf_dir):
    import numpy as np
    import pyarrow as pa

    from catchment.llm.common import blocks

    random = np.random.default_rng(5)
    table = random.normal(size=(3, language.BUCKETS)).astype(np.float32)
    table[:, 0] = 0
    bias = random.normal(size=3)
    docs = [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40).collect()]
    texts = [None, "", "a", "ab", "  ", "Ünï çødé 日本", "A-b 9 C", "x" * 700, *[t[:3000] for t in docs if t]]
    for most in (1, 50, 1 << 20):  # texts alone and together in a block
        got = np.concatenate([language.block_logits(b, table, bias) for b in blocks(pa.array(texts), most)])
        assert np.allclose(got, [plain_logits(t or "", table, bias) for t in texts], atol=1e-5)


def test_long_texts_reach_the_driver_in_part(spark, monkeypatch):
    monkeypatch.setattr(language, "MOST_CHARS", 100)
    seen = []
    monkeypatch.setattr(language, "train", lambda texts, languages: seen.extend(texts))
    long = [" ".join(f"w{i}x{k}" for k in range(500)) for i in range(30)]
    language.fit(spark.createDataFrame([(i, t, "en") for i, t in enumerate([*long, "short one"])], "doc_id bigint, text string, lang string"))
    assert {len(t) for t in seen} <= {100, 9} and all(any(t in whole for whole in [*long, "short one"]) for t in seen)
    assert len({t[:20] for t in seen}) > 5


def test_held_out_labels_are_never_read(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    from pyspark.sql import functions as F

    lied = docs.withColumn("lang", F.when(language.held_out(), F.lit("xx")).otherwise(F.col("lang")))
    a, b = (sorted(map(tuple, language.identify_languages(d).collect())) for d in (docs, lied))
    assert a == b


def test_the_sample_is_bounded(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert language.sample_rows(docs, per_language=10, most=25).count() <= 25


def test_every_language_is_learned(spark):
    """More languages than shares of the full size, and one of very few rows."""
    rows = [(100 * k + i, " ".join(f"{chr(97 + k) * 3}{chr(97 + i * j % 7)}" for j in range(20)), f"l{k:02}") for k in range(24) for i in range(40)]
    rows += [(i, "7zz8 9zz7 " * 20, "rare") for i in range(9000, 9003)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    sample = language.sample_rows(docs, per_language=30, most=250)
    assert sample.count() <= 250 and sample.select("lang").distinct().count() == 25
    assert language.fit(docs, per_language=30, most=250).languages == sorted({r[2] for r in rows})
    got = language.identify_languages(docs, per_language=30, most=250).collect()
    truth = {r[0]: r[2] for r in rows}
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in got) >= 0.95 * len(got)


def test_no_language_stands_aside_as_a_whole(monkeypatch):
    seen = []
    monkeypatch.setattr(language, "_calibrate", lambda texts, label, aside, *_: seen.append(aside.tolist()) or (1.0, 0.0))
    for seed in range(8):
        language.train([f"text {k}" for k in range(10)], [f"l{k // 2}" for k in range(8)] + ["one", "two"], seed)
    assert all(8 not in aside and 9 not in aside for aside in seen)


def test_hard_rows(spark):
    docs = hard_documents(spark)
    rows = language.identify_languages(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        if r["doc_id"] in (3, 4, 5, 9):
            assert (r["lang_pred"], r["score"], r["rejected"]) == ("und", 0.0, True)
        else:
            assert r["lang_pred"] in {"en", "de", "fr"}
        assert r["doc_id"] is not None or not r["held_out"]
    twins = {(r["lang_pred"], r["score"]) for r in rows if r["doc_id"] in (1, 2)}
    assert len(twins) == 1
    assert language.identify_languages(no_documents(spark)).count() == 0


def test_nothing_to_learn(spark):
    docs = hard_documents(spark).selectExpr("doc_id", "text", "cast(null as string) lang")
    assert {r["lang_pred"] for r in language.identify_languages(docs).collect()} == {"und"}
    assert {r["doc_id"] for r in language.keep_known(docs).collect()}.isdisjoint({3, 4, 5, 9})


def test_keeping_known_rows(spark):
    docs = hard_documents(spark)
    kept = language.keep_known(docs)
    assert kept.schema == docs.schema
    known = [r["doc_id"] for r in language.identify_languages(docs).collect() if not r["rejected"]]
    assert sorted(map(str, known)) == sorted(str(r["doc_id"]) for r in kept.collect())


@pytest.mark.parametrize("texts", [["a"], ["", "b"], ["same", "same"]])
def test_tiny_samples_train(texts):
    assert language.train(texts, ["en"] * len(texts)).languages == ["en"]
