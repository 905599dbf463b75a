"""Every registered query of the core against its SQL on the small tables."""

import duckdb
import pytest

from weftgraph import registry


@pytest.fixture(scope="module")
def sql(small):
    con = duckdb.connect()
    for name in "lineitem orders part events embeddings result_edge vertices page_title query_callback documents eval_item".split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{small}/{name}.parquet'")
    return con


def shown(value):
    if isinstance(value, float):
        return "nan" if value != value else f"{value:.6g}"
    return str(value)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, sql, small, name):
    df = registry.queries()[name](spark, small)
    columns = sorted(df.columns)
    rows = df.collect()
    got = sorted([shown(r[c]) for c in columns] for r in rows)
    # a NaN equals nothing, so rows that hold one are only comparable by other columns
    exact = [tuple(str(v) for v in r if not isinstance(v, float)) for r in rows]
    assert len(set(exact)) == len(exact) or not any(v != v for r in rows for v in r if isinstance(v, float))
    text = registry.oracle_sql().get(name)
    if text is None:
        assert got
        return
    result = sql.execute(text)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted([shown(row[i]) for i in at] for row in result.fetchall())
