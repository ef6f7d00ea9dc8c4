"""SQL of the training-data queries gives what they give."""

import duckdb
import pytest

from framelark.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cur = con.execute(ORACLE_SQL[name])
    columns = [c[0] for c in cur.description]
    out = QUERIES[name](spark, SF)
    assert sorted(out.columns) == sorted(columns)
    assert sorted((tuple(r[c] for c in columns) for r in out.collect()), key=repr) == sorted(map(tuple, cur.fetchall()), key=repr)
