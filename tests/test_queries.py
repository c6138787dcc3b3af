"""Every query that has SQL equals it on the smallest tables; the others run."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from verify import rows_of

QUERIES = {k: v for k, v in entry.queries().items() if entry.QUERY_HOME[k] != "llm"}


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(data).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    got = [tuple(r) for r in df.collect()]
    if (sql := entry.oracle_sql().get(name)) is None:
        assert len(got) == len({repr(r) for r in got}), "rows come twice"
        if name in ("win_10", "win_11"):
            assert len({r[df.columns.index("target")].lower() for r in got}) == len(got), "a target is given out twice"
        return
    cur = duck.execute(sql)
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert rows_of(df.columns, got) == rows_of(cols, cur.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
