"""Every core query against its SQL."""

import math

import duckdb
import pytest
from refweave import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else "inf" if math.isinf(v) else f"{v:.9g}"
    return f"{v:.9g}" if isinstance(v, int) and not isinstance(v, bool) and abs(v) < 1e6 else str(v)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    got = catalog.QUERIES[name](spark, DATA)
    rows = sorted(tuple(plain(v) for _, v in sorted(r.asDict().items())) for r in got.collect())
    if name not in catalog.ORACLES:
        assert rows
        return
    want = con.execute(catalog.ORACLES[name])
    columns = [x[0] for x in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert rows == sorted(tuple(plain(v) for _, v in sorted(zip(columns, r))) for r in want.fetchall())


def test_rows_only_queries_hold_their_invariants(spark):
    poses = catalog.QUERIES["j18_x1_x2_matched_poses"](spark, DATA).collect()
    assert all(r.matched == r.n and r.exactly_one for r in poses)
    shapes = catalog.QUERIES["h19_h20_x19_congruent_shapes"](spark, DATA).collect()
    assert all(r.prototypes <= r.shapes == r.congruent for r in shapes)


def test_entry_and_contract(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 7
    assert set(entry.oracle_sql()) <= set(entry.queries())
