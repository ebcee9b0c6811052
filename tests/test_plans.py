import duckdb
import pandas as pd
import pytest

from jobs import queries as jobs
from sightline.plans import catalogue

QUERIES, ORACLES = catalogue.QUERIES | jobs.QUERIES, catalogue.ORACLES | jobs.ORACLES
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in ("events", "documents"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    return con


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLES.keys() and len(QUERIES) > 60


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_against_sql(spark, duck, name):
    mine, theirs = QUERIES[name](spark, SF).toPandas(), duck.sql(ORACLES[name]).df()
    columns = sorted(mine.columns)
    assert columns == sorted(theirs.columns)
    a, b = (x[columns].sort_values(columns).reset_index(drop=True) for x in (mine, theirs))
    pd.testing.assert_frame_equal(a, b, check_dtype=False, rtol=0, atol=1.1e-6)


def test_record_is_in_order(spark):
    rows = [(r.frame_idx, r.approach, r.pos) for r in catalogue.QUERIES["sweep_record"](spark, SF).select("frame_idx", "approach", "pos").collect()]
    assert rows == sorted(rows) and len(rows) == len(set(rows))
    pairs = [r.n for r in catalogue.QUERIES["near_miss_pair_types"](spark, SF).collect()]
    assert pairs == sorted(pairs, reverse=True)
