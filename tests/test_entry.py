"""The driver's contract, and every catalogue query against its SQL."""

from __future__ import annotations

from pathlib import Path

import pytest

import __spark_entry__ as entry_point
from ridgemill.catalogue import CATALOGUE

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")


def test_contract(spark):
    assert entry_point.entry(spark).count() == 25
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


@pytest.mark.parametrize("name", [k for k, (_, sql) in CATALOGUE.items() if sql])
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    query, sql = CATALOGUE[name]
    mine = query(spark, str(DATA))
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    theirs = [dict(zip(names, row, strict=True)) for row in result.fetchall()]
    plain = lambda v: round(float(v), 6) + 0.0 if isinstance(v, float) else v
    assert sorted(mine.columns) == sorted(names)
    rows = lambda found: sorted((repr([plain(r[c]) for c in sorted(names)]) for r in found))
    assert rows(r.asDict() for r in mine.collect()) == rows(theirs)
