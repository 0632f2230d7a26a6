"""The registered queries run, and equal their SQL where there is one."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import duckdb
import pytest

from basketlake.llm import queries

DATA = Path("/root/testdata/sf0.001")


@pytest.mark.parametrize("name", queries.QUERIES)
def test_query(spark, name):
    got = queries.QUERIES[name](spark, str(DATA))
    rows = got.collect()
    assert rows
    if name in queries.ORACLE:
        con = duckdb.connect()
        for p in DATA.glob("*.parquet"):
            con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
        want = con.sql(queries.ORACLE[name])
        columns = sorted(got.columns)
        assert columns == sorted(want.columns)
        at = [want.columns.index(c) for c in columns]
        assert Counter(tuple(str(r[c]) for c in columns) for r in rows) == Counter(tuple(str(r[i]) for i in at) for r in want.fetchall())
