"""Queries that SQL can express, against their SQL in DuckDB."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from quillgrove.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    out, want = queries.QUERIES[name](spark, sf), con.execute(queries.ORACLE_SQL[name])
    assert sorted(out.columns) == sorted(d[0] for d in want.description)
    order = [out.columns.index(d[0]) for d in want.description]
    assert sorted(tuple(r[i] for i in order) for r in out.collect()) == sorted(want.fetchall())
