"""Every named query against its SQL in DuckDB, over the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pandas as pd
import pytest
from tallyframe.plans.exit_oracles import EXIT_SQL
from tallyframe.plans.oracles import ORACLE_SQL as PLAIN_SQL
from tallyframe.plans.outcome_oracles import OUTCOME_SQL
from tallyframe.plans.queries import QUERIES
from tallyframe.plans.rich_oracles import RICH_SQL
from tallyframe.plans.signal_oracles import SIGNAL_SQL
from tallyframe.plans.signal_queries import SIGNAL_QUERIES
from tallyframe.plans.study_queries import STUDY_QUERIES, STUDY_SQL
from tallyframe.plans.table_queries import TABLE_QUERIES, TABLE_SQL

DATA = "/root/testdata/sf0.001"
ORACLE_SQL = PLAIN_SQL | EXIT_SQL | OUTCOME_SQL | RICH_SQL | SIGNAL_SQL | TABLE_SQL | STUDY_SQL
ALL = QUERIES | SIGNAL_QUERIES | TABLE_QUERIES | STUDY_QUERIES
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def normal(frame: pd.DataFrame) -> list[tuple]:
    cols = sorted(frame.columns)

    def value(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return ""
        return f"{round(float(v), 5) + 0.0:.5f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(map(value, row)) for row in frame[cols].astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for f in os.listdir(DATA):
        path = f"{DATA}/{f}"
        db.sql(f"create view {f.removesuffix('.parquet')} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return db


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    ours, theirs = ALL[name](spark, DATA).toPandas(), duck.sql(ORACLE_SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert normal(ours) == normal(theirs)
