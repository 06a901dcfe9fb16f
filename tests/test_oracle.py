"""Every query against its oracle SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from gistline.plans import catalog, oracle
from scripts.compare import TABLES, normal

SF = "/root/testdata/sf0.001"
# These run the digests of other queries once more; scripts/compare.py covers them.
SLOW = {"distill_all", "distill_runs", "reduction_report", "digest_tokens", "reduction_pct", "format_response"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def test_every_query_has_an_oracle():
    assert set(catalog.QUERIES) == set(oracle.ORACLE) and set(catalog.QUERIES) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not there")
@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n not in SLOW])
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted("|".join(normal(r[c]) for c in cols) for r in df.collect())
    rel = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    assert got == sorted("|".join(normal(r[names.index(c)]) for c in cols) for r in rel.fetchall())
