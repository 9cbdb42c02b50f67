"""Registered queries of the training-data operators."""

import os

import pytest

import corpus_pipeline
from checks.compare import cell, connect, rows_of
from citemill.llm.queries import QUERIES
from citemill.llm.sql import ORACLES
from tests.llm.test_near_copies import brute_kept

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables are not here")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14)) and set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    df = QUERIES[name](spark, SF_DIR)
    result = con.execute(ORACLES[name])
    assert rows_of(df.columns, df.collect()) == rows_of([c[0] for c in result.description], result.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - {"op8_decontamination"}))  # op11 and op12 have SQL
def test_one_row_for_each_input(spark, con, name):
    table, key = ("pages", "page_id") if name.startswith("op10") else ("documents", "doc_id")
    got = [r[0] for r in QUERIES[name](spark, SF_DIR).select(key).collect()]
    assert sorted(got) == sorted(cell(r[0]) for r in con.execute(f"SELECT {key} FROM {table}").fetchall())


def test_pipeline_stages(spark, con):
    """Each stage keeps the columns, and takes only what its rule names."""
    from citemill.llm import decontamination, toxicity
    from citemill.session import store

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    items = spark.read.parquet(f"{SF_DIR}/benchmark.parquet")
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "token_files"]
    expected = {
        "toxicity": lambda d: ids(toxicity.score(d, toxicity.learn(d, labels)).where("predicted = 0")),
        "near_duplicates": lambda d: brute_kept([(r["doc_id"], r["text"]) for r in d.select("doc_id", "text").orderBy("doc_id").collect()]),
        "decontamination": lambda d: sorted(set(ids(d)) - set(ids(decontamination.contaminated(d, items)))),
    }
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = store(stage(spark, docs, SF_DIR), f"test-{name}")
        assert out.columns == docs.columns
        assert out.exceptAll(docs).count() == 0 or name == "mixing"
        if name in expected:
            assert ids(out) == expected[name](docs)
        docs = out
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR).orderBy("start").collect()
    assert [r["doc_id"] for r in last] == ids(docs)
    assert corpus_pipeline.run(spark, SF_DIR).count() == len(last)
