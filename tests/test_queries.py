"""Every registered query against its SQL at the smallest size."""

from pathlib import Path

import duckdb
import pytest

from claimloom import page_queries, queries, text_queries  # noqa: F401

DATA = Path("/root/testdata/sf0.001")


def norm(v):
    if isinstance(v, float):
        return round(v, 9)
    return tuple(map(norm, v)) if isinstance(v, list | tuple) else str(v)[:26] if hasattr(v, "isoformat") else v


def compare(spark, f, sql):
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = f(spark, str(DATA))
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    if sql:
        cur = con.execute(sql)
        names = [d[0] for d in cur.description]
        assert sorted(names) == cols
        assert got == sorted((tuple(norm(r[names.index(c)]) for c in cols) for r in cur.fetchall()), key=repr)
    return got


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.Q))
def test_query(spark, name):
    compare(spark, queries.Q[name], queries.SQL.get(name))
