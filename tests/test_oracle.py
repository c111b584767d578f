"""Every query with SQL against DuckDB on the smallest tables."""

import duckdb
import pytest

from pageloom.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df):
    cols = sorted(df.columns)
    norm = lambda v: round(v, 9) if isinstance(v, float) else v
    return cols, sorted((tuple(norm(v) for v in r) for r in df[cols].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = rows(QUERIES[name](spark, SF).toPandas()), rows(con.execute(ORACLE_SQL[name]).df())
    assert got == want
