"""Every query of the engine's own operators against its SQL in DuckDB, over the smallest tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest

from tabulith.queries import ORACLE_SQL, QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for path in Path(SMALL).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value) -> str:
    if isinstance(value, (list, tuple, np.ndarray)):
        return str([_plain(v) for v in value])
    if value is None or value is pd.NaT or value is pd.NA or (isinstance(value, float) and value != value):
        return "null"
    if isinstance(value, (bool, np.bool_)):
        return str(bool(value))
    if isinstance(value, (int, float, np.number)) or type(value).__name__ == "Decimal":
        return f"{float(value):.6f}"
    return str(value)


def rows_of(frame: pd.DataFrame) -> list[tuple]:
    return sorted(tuple(map(_plain, row)) for row in frame[sorted(frame.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_is_its_sql(spark, con, name):
    found, wanted = QUERIES[name](spark, SMALL).toPandas(), con.execute(ORACLE_SQL[name]).df()
    assert sorted(found.columns) == sorted(wanted.columns)
    assert rows_of(found) == rows_of(wanted)


#: What must hold of the queries that SQL can't express; their operators have brute-force tests besides.
CHECKS = {
    "ml1_nbsvm": lambda rows, count: len(rows) == 1 and 0.5 < rows[0]["accuracy"] <= 1,
    "ml3_stored_model": lambda rows, count: len(rows) == 1 and 0.5 < rows[0]["accuracy"] <= 1,
    "ml2_group_split": lambda rows, count: len(rows) == 2 and sum(r["rows"] for r in rows) == count("labels") and all(0 < r["contents"] <= r["rows"] for r in rows),
    "ml10_contributions": lambda rows, count: len(rows) == count("labels") and all(abs(r["log_odds"] - r["of_terms"]) < 1e-4 for r in rows) and len({r["log_odds"] for r in rows}) > 10,
    "tx13_page_fragments": lambda rows, count: len({r["page_id"] for r in rows}) == count("pages"),
    "tb28_match_tables": lambda rows, count: len(rows) > 0 and all(r["hits"] > 0 for r in rows),
    "ev9_evidences": lambda rows, count: len({r["ext_id"] for r in rows}) == count("benchmark"),
}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_without_sql(spark, con, name):
    assert CHECKS[name](QUERIES[name](spark, SMALL).collect(), lambda table: con.execute(f"SELECT count(*) FROM {table}").fetchone()[0])


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())
