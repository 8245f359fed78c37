"""Every query against the SQL that tells the same, run by DuckDB."""

import duckdb
import pytest

from pagewright import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS FROM '{sf_dir}/{t}.parquet'")
    return con


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    found = ordered(tuple(r[c] for c in columns) for r in df.collect())
    if name not in catalog.ORACLE_SQL:
        assert found
        return
    told = duck.sql(catalog.ORACLE_SQL[name])
    assert sorted(told.columns) == columns
    at = [told.columns.index(c) for c in columns]
    assert found == ordered(tuple(r[i] for i in at) for r in told.fetchall())


def test_entry_has_rows(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(catalog.QUERIES) <= set(entry.queries()) and set(catalog.ORACLE_SQL) <= set(entry.oracle_sql())
