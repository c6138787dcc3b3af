"""The pN queries on the smallest tables."""

import duckdb
import pytest

from stacksift.llm import queries
from verify import rows_of

COLUMNS = {"p1_found": ["track_id", "candidate_id"], "p2_found": ["name_a", "name_b"], "p3_found": ["group_id", "track_id"], "p4_found": ["track_id", "field"], "p5_found": ["track_id", "field"], "p7_found": ["group_root", "track_id"], "p8_ids": ["doc_id", "ids"], "p10_found": ["doc_id", "kind", "found_text"]}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_distinct_rows(spark, data, name):
    df = queries.QUERIES[name](spark, data)
    assert df.columns == COLUMNS[name]
    rows = [repr(r) for r in df.collect()]
    assert rows and len(rows) == len(set(rows))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_sql(spark, data, name):
    from pathlib import Path

    con = duckdb.connect()
    for p in Path(data).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    cur = con.execute(queries.ORACLES[name])
    df = queries.QUERIES[name](spark, data)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of([c[0] for c in cur.description], cur.fetchall())


def test_containers_hold_every_document(spark, data):
    packed = queries.QUERIES["p9_fill"](spark, data).collect()
    assert len(packed) == 4 and all(r.fullest <= r.capacity_tokens and r.waste < 0.05 or r.containers <= r.least + 1 for r in packed)
