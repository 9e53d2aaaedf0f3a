"""The SQL statements of this folder's queries, run on the driver's smallest tables."""

import os

import pytest

from petrel.llm.oracles import ORACLES
from petrel.llm.queries import QUERIES

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables here")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_statement(spark, name):
    db = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = db.sql(ORACLES[name])
    columns = sorted(want.columns)
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == columns
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr) == sorted(want.select(*columns).fetchall(), key=repr)
