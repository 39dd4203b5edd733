"""Every query with SQL against DuckDB on the same tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

SQL = entry.oracle_sql()
NAMES = [n for n in SQL if not n.startswith("op")]


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])

    def cell(v):
        if isinstance(v, bool) or v is None:
            return str(v)
        if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
            return f"{float(v):.6g}"
        if hasattr(v, "isoformat"):
            return v.isoformat()[:19]
        return str(v)

    return [columns[k] for k in order], sorted(tuple(cell(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_query(name, spark, sf_dir, con):
    df = entry.queries()[name](spark, sf_dir)
    ours = canonical(df.columns, df.collect())
    got = con.execute(SQL[name])
    theirs = canonical([d[0] for d in got.description], got.fetchall())
    assert ours[0] == theirs[0]
    assert len(ours[1]) == len(theirs[1])
    wrong = [(a, b) for a, b in zip(ours[1], theirs[1]) if a != b]
    assert not wrong, wrong[:3]
