import math
import os

import pytest

from petrel.plans import registry

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables here")


def plain(x):
    x = x.item() if hasattr(x, "item") else x
    return None if isinstance(x, float) and math.isnan(x) else round(x, 6) if isinstance(x, float) else x


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_oracle(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted([tuple(plain(v) for v in r) for r in df.select(*columns).collect()], key=repr)
    want = con.execute(registry.ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted([tuple(plain(r[i]) for i in at) for r in want.fetchall()], key=repr)


@pytest.mark.parametrize("name", sorted(registry.QUERIES.keys() - registry.ORACLES.keys()))
def test_query_without_oracle_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0
