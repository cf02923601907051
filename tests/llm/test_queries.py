"""Registered operator queries: SQL equivalents, contracts, the pipeline."""

from __future__ import annotations

from pathlib import Path

import pytest

import __spark_entry__ as entry_point
import corpus_pipeline
from ridgemill.llm.queries import ORACLES, QUERIES

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")


def test_registered():
    names = entry_point.queries()
    assert "pipeline" in names and all(sum(k.startswith(f"op{n}_") for k in names) == 1 for n in range(1, 14))


@pytest.mark.parametrize("name", list(ORACLES))
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "pages"):
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    result = connection.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    mine = QUERIES[name](spark, str(DATA))
    assert sorted(names) == sorted(mine.columns)
    assert sorted(repr([r[c] for c in names]) for r in mine.collect()) == sorted(repr(list(r)) for r in result.fetchall())


@pytest.mark.parametrize("name", ["op3_benchmark_decontamination", "op6_chat_formatting"])
def test_native_plans(spark, name):
    plan = QUERIES[name](spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    before = {r["doc_id"] for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES:
        after = corpus_pipeline.keep(stage(spark, docs, str(DATA)))
        if name != "packing":
            assert after.columns == docs.columns
        kept = {r["doc_id"] for r in after.select("doc_id").collect()}
        assert kept <= before and len(kept) >= 0.7 * len(before)
        docs, before = after, kept
    assert "sequence_id" in docs.columns
    assert corpus_pipeline.run(spark, str(DATA)).count() == docs.count()


def test_pipeline_stages_on_odd_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    odd = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (None, "some text", "en", "s", 9), (None, None, None, None, None), (3, "a b c", "en", "s", 5), (3, "a b c", "en", "s", 5)], schema)
    for docs in (odd, odd.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, str(DATA))
            docs.collect()
