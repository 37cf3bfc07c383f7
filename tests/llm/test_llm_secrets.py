import hashlib
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from catchment.llm import secret_index as s
from catchment.llm.common import blocks
from hard_rows import hard_documents, no_documents

PARTS = ["password", "API_KEY", "apikey", "passwd", "Token", "secret", "=", ":", ' "', "'", " ", "AKIA", "ABCDEFGH12345678", "0123456789abcdef",
         "deadbeef", "x", "é", "ghp_", "A" * 36, "https://", "u:p@h", "ſecret", "Key", "eyJhbGciOiJI", ".eyJzdWIiOiIx", "-----BEGIN RSA PRIVATE KEY-----", "\n"]


def plain(text, rules=s.RULES):
    found = []
    for k, rule in enumerate(rules):
        for m in re.finditer(rule.pattern, text or ""):
            low, high = m.span(rule.group)
            if high - low >= rule.least:
                found.append((m.start(), k, m.end()))
    return sorted(found)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.lists(st.sampled_from(PARTS), max_size=12).map("".join)), min_size=1, max_size=6), st.integers(1, 80))
def test_index_finds_what_full_scans_find(rows, most):
    scanner, got = s.Scanner(), []
    for block in blocks(pa.array(rows, pa.string()), most):
        got += scanner.scan(block)
    assert got == [plain(t) for t in rows]


def holds(query, text):
    data = bytes(s.LOWER[np.frombuffer(text.encode(), np.uint8)])
    kind = query[0]
    if kind == "has":
        return query[1] in data
    return True if kind == "all" else (all if kind == "and" else any)(holds(q, text) for q in query[1:])


PATTERNS = [r.pattern for r in s.RULES] + ["abc|abd", "(foo|bar)+baz", "a?bcd", "x{3}yz", "(?:ab){2,}c", "[ab]cd", "a.c", "", "ab", "(foo)?(bar)?", "^start(ed)?$", "foo(?=bar)baz*"]


@settings(max_examples=200, deadline=None)
@given(st.sampled_from(PATTERNS), st.lists(st.sampled_from(["foo", "bar", "baz", "abc", "abd", "cd", "xxx", "yz", "started", "a", "b", *PARTS]), max_size=8).map("".join))
def test_queries_never_miss(pattern, text):
    if re.search(pattern, text):
        assert holds(s.trigram_query(pattern), text)


def test_queries():
    assert s.trigram_query("[0-9a-f]+") == s.ALL
    assert s.trigram_query("AKIA[A-Z0-9]+") == ("and", ("has", b"aki"), ("has", b"kia"))
    assert s.trigrams_of(s.trigram_query("(abcd|wxy)z")) == {b"abc", b"bcd", b"cdz", b"wxy", b"xyz"}


def test_only_candidates_are_searched():
    scanner, searched = s.Scanner(), []
    scanner.search = [lambda text, k=k: searched.append((k, text)) or iter(()) for k in range(len(scanner.rules))]
    for block in blocks(pa.array(["nothing here", "my token", "AKIA"])):
        scanner.scan(block)
    full = {k for k, q in enumerate(scanner.queries) if q == s.ALL}
    assert {(k, t) for k, t in searched if k not in full} == {(0, "my token"), (1, "AKIA")}


def test_registered_query_against_plain_python(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in s.find_secrets(docs).collect():
        found = plain(texts[r["doc_id"]])
        name = lambda spans: ",".join(f"{s.RULES[k].kind}:{a}:{b}" for a, k, b in spans)
        base = [x for x in found if x[1] < 3]
        assert r["spans"] == name(found)
        assert r["base_sha256"] == hashlib.sha256(name(base).encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(x[1] == k for x in base) for k in range(3)]


def test_hard_rows(spark):
    docs = hard_documents(spark)
    rows = s.find_secrets(docs).collect()
    assert len(rows) == docs.count()
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[3]["spans"] == "" == by_id[4]["spans"] and by_id[3]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert (by_id[8]["n_assign"], by_id[8]["n_access"], by_id[8]["n_hex"]) == (1, 1, 1)
    assert s.find_secrets(no_documents(spark)).count() == 0


def test_masking(spark):
    docs = hard_documents(spark)
    masked = s.mask_secrets(docs)
    assert masked.schema == docs.schema
    before, after = ({r["doc_id"]: r["text"] for r in df.collect()} for df in (docs, masked))
    assert after.pop(8) == "<assign> und <access> <hex>" and before.pop(8)
    assert before == after
    assert s.mask_text("abcdefgh", [(1, 3, "x"), (2, 5, "y"), (6, 7, "z")]) == "a<x>f<z>h"
    assert s.mask_secrets(no_documents(spark)).count() == 0
