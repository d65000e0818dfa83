"""The driver's contract: entry, names, and every query against its SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from kinfolio.plans.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, list):
        return [plain(x) for x in v]
    if hasattr(v, "as_tuple"):
        v = float(v)
    if isinstance(v, float):
        return round(v, 5) + 0.0
    return v


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    have = sorted((str([plain(r[c]) for c in cols]) for r in got.collect()))
    found = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    want = sorted(str([plain(dict(zip(names, r, strict=True))[c]) for c in cols]) for r in found.fetchall())
    assert sorted(names) == cols
    assert have == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_other_queries_run(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["source", "target", "semantic", "score", "rank"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
