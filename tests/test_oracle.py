"""Every query with SQL gives what DuckDB gives on the same tables."""

import duckdb
import pytest

from framelark.plans import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "conversations", "labels"]


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def split(row):
    """What must be equal, and the numbers that may differ in the last place a query gives."""
    floats = [float(x) for x in row if isinstance(x, float) or type(x).__name__ == "Decimal"]
    return tuple(repr(x) for x in row if not isinstance(x, float) and type(x).__name__ != "Decimal"), floats


def same(a: float, b: float) -> bool:
    return a == b or (a != a and b != b) or abs(a - b) <= 1.01e-6 + 1e-12 * abs(a)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, db, name):
    out = QUERIES[name](spark, SF)
    columns = sorted(out.columns)
    got = [tuple(r[c] for c in columns) for r in out.collect()]
    assert got or name == "se5_added_frames"
    if name in ORACLE_SQL:
        cur = db.execute(ORACLE_SQL[name])
        names = [c[0] for c in cur.description]
        assert sorted(names) == columns
        want = [tuple(r[names.index(c)] for c in columns) for r in cur.fetchall()]
        got, want = sorted(map(split, got)), sorted(map(split, want))
        assert [k for k, _ in got] == [k for k, _ in want]
        assert all(len(x) == len(y) and all(map(same, x, y)) for (_, x), (_, y) in zip(got, want, strict=True))
