import os
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from catchment.llm import packing, suffix_pieces as sp
from hard_rows import TEXTS, documents, hard_documents, no_documents

pytestmark = pytest.mark.skipif(not os.path.exists(sp.MODEL), reason="no tokenizer files here")
LOADED = {}


def trees():
    if not LOADED:
        import sentencepiece

        LOADED["trees"] = sp.PieceTrees(sp.PieceModel.load())
        LOADED["library"] = sentencepiece.SentencePieceProcessor(model_file=sp.MODEL)
    return LOADED["trees"]


def encoded(texts, most=1 << 21):
    encoder, out = sp.Encoder(trees()), []
    for group in sp._grouped(sp.blocks(sp.pc.replace_substring(pa.array(texts), sp.BLANK, " "), most), 3):
        for block, ids, count in encoder.encode(group):
            assert len(count) == block.n
            out += [x.tolist() for x in np.split(ids, np.cumsum(count)[:-1])]
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab theinro.\n  日é=-1\t▁🙂_xy", max_size=40), min_size=1, max_size=8), st.integers(1, 100))
def test_ids_equal_the_library(texts, most):
    assert encoded(texts, most) == (trees() and LOADED["library"].encode(texts))


def test_pieces_and_runs_equal_the_library():
    trees()
    r = random.Random(5)
    short = [p.decode() for i, p in enumerate(trees().model.pieces) if trees().model.normal[i] and len(p) < 7]
    texts = ["".join(r.choices(short, k=r.randint(1, 14))) for _ in range(1500)]
    texts += [" " * n + c for n in range(40) for c in ("", "x", "日", "\n", "\nx")] + ["a" * n for n in range(60)] + ["ab" * 500]
    assert encoded(texts) == LOADED["library"].encode(texts)


def test_forgetting_words_changes_nothing(monkeypatch):
    monkeypatch.setattr(sp, "MOST_WORDS", 5)
    texts = [t or "" for _, t, _, _ in TEXTS] * 3
    assert encoded(texts, 50) == (trees() and LOADED["library"].encode(texts))


def test_suffix_array_is_sorted():
    words = [b"banana", b" ban", b"an", b"banana bandana"[:6], b"x" * 40]
    index = sp.SuffixArray(words, 7)
    suffixes = [index.text[index.at[k]:index.end[index.word[k]]].tobytes() for k in index.order]
    assert suffixes == sorted(suffixes)
    low, high = index.ranges(sp.chunk_keys([b"an", b"x" * 9, b"q", b" ban", b"x" * 45]))
    assert (high - low).tolist() == [6, 32, 0, 1, 0]


def test_registered_query_equals_the_library(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    trees()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = sp.encode_texts(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r["ids"] == LOADED["library"].encode(texts[r["doc_id"]]) and r["n_ids"] == len(r["ids"]) and r["round_trip"]


def test_hard_rows_round_trip(spark):
    trees()
    docs = hard_documents(spark)
    rows = sp.encode_texts(docs)
    assert rows.count() == docs.count()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in rows.collect():
        text = texts[r["doc_id"]] or ""
        assert r["ids"] == LOADED["library"].encode(text) and r["round_trip"] == ("▁" not in text)
    for r in sp.decode_texts(rows).collect():
        assert r["text"] == (texts[r["doc_id"]] or "").replace("▁", " ")
    assert sp.encode_texts(no_documents(spark)).count() == 0


# --- packing -----------------------------------------------------------------------------


def plain_best_fit(sizes, width):
    free, rows = [], []
    for item in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        fits = [f for f in free if f >= sizes[item]]
        if fits:
            free[free.index(min(fits))] -= sizes[item]
        else:
            free.append(width - sizes[item])
            rows.append(None)
    return sorted(free)


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 40).flatmap(lambda w: st.tuples(st.just(w), st.lists(st.integers(1, w), max_size=60))))
def test_best_fit(case):
    width, sizes = case
    rows = packing.best_fit(np.array(sizes, np.int64), width)
    assert sorted(i for row in rows for i in row) == list(range(len(sizes)))
    assert sorted(width - sum(sizes[i] for i in row) for row in rows) == plain_best_fit(sizes, width)


def pieces_of(packed):
    out = {}
    for r in packing.unpack(packed).collect():
        out.setdefault(r["doc_id"], []).append((r["piece_start"], r["ids"]))
    return {d: [i for _, ids in sorted(parts) for i in ids] for d, parts in out.items()}


def test_packing_loses_nothing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    packed = packing.pack_texts(docs, width=500)
    encoding = packing._encoding(packing.load_ranks())
    assert pieces_of(packed) == {d: [*encoding.encode_ordinary(t), packing.END] for d, t in texts.items() if t}
    rows = packed.collect()
    assert len({r["pack_id"] for r in rows}) == len(rows)
    assert sum(r["n_tokens"] for r in rows) >= 0.97 * 500 * (len(rows) - 1)
    for r in rows:
        assert len(r["ids"]) == 1000 and r["cu_seqlens"][0] == 0 and r["cu_seqlens"][-1] == r["n_tokens"] <= 500
        assert r["resets"] == r["cu_seqlens"][:-1] and len(r["doc_ids"]) == len(r["resets"]) == len(r["piece_starts"])
        positions = packing.position_ids(r["cu_seqlens"], 500)
        assert [int(k) for k in np.flatnonzero(positions[:r["n_tokens"]] == 0)] == r["resets"]


def test_packing_hard_rows(spark, tmp_path):
    docs = hard_documents(spark)
    packed = packing.pack_texts(docs)
    packing.write_packed(packed, str(tmp_path / "packed"))
    got = pieces_of(spark.read.parquet(str(tmp_path / "packed")))
    assert set(got) == {i for i, t, _, _ in TEXTS if t}
    encoding = packing._encoding(packing.load_ranks())
    assert got[7] == [*encoding.encode_ordinary(dict((i, t) for i, t, _, _ in TEXTS)[7]), packing.END]
    assert packing.pack_texts(no_documents(spark)).count() == 0
    assert packing.pack_texts(documents(spark, [None, ""])).count() == 0
