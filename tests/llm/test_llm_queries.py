import re

import pytest

import __spark_entry__ as contract
import corpus_pipeline
from catchment.llm.queries import ORACLES, QUERIES
from catchment.session import fresh_path
from hard_rows import hard_documents, no_documents
from oracle_check import connect, differences


def test_all_are_registered():
    assert {int(re.match(r"op(\d+)_", name)[1]) for name in QUERIES} == set(range(1, 14))
    assert {*QUERIES, "pipeline"} <= set(contract.queries()) and set(ORACLES) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, sf_dir, name):
    assert differences(QUERIES[name](spark, sf_dir), connect(sf_dir), ORACLES[name]) == []


def written(spark, df):
    path = fresh_path(spark, "stage")
    df.write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("docs", [hard_documents, no_documents])
def test_stages_on_hard_rows(spark, docs):
    docs = docs(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = written(spark, stage(spark, docs, ""))
        assert after.columns == docs.columns, name
        docs = after
    assert {"doc_id", "ids", "n_ids"} <= set(corpus_pipeline.STAGES[-1][1](spark, docs, "").columns)


def test_what_each_stage_decides(spark):
    ids = lambda df: sorted(str(r["doc_id"]) for r in df.collect())
    docs = hard_documents(spark)
    stage = dict(corpus_pipeline.STAGES)
    known = written(spark, stage["language"](spark, docs, ""))
    assert set(ids(docs)) - set(ids(known)) == {"3", "4", "5", "9"}
    single = written(spark, stage["near_duplicates"](spark, known, ""))
    assert set(ids(known)) - set(ids(single)) == {"2"}
    masked = written(spark, stage["secrets"](spark, single, ""))
    assert ids(masked) == ids(single)
    text = {r["doc_id"]: r["text"] for r in masked.collect()}
    assert text[8] == "<assign> und <access> <hex>"
    assert all(r["n_chars"] == len(r["text"]) for r in masked.collect())


def test_the_whole_pipeline(spark, sf_dir):
    from catchment.llm import superminhash

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    result = corpus_pipeline.run(spark, sf_dir).collect()
    kept = {r["doc_id"] for r in superminhash.near_duplicates(docs).where("kept").collect()}
    assert result and {r["doc_id"] for r in result} <= kept
    assert all(r["round_trip"] for r in result)
