"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest
from loomgraph.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    return round(value, 9) if isinstance(value, float) else value


def same(spark_rows, con, sql):
    names = sorted(spark_rows.columns)
    cursor = con.execute(sql)
    theirs = [d[0] for d in cursor.description]
    assert sorted(theirs) == names
    want = sorted((tuple(plain(row[theirs.index(n)]) for n in names) for row in cursor.fetchall()), key=repr)
    got = sorted((tuple(plain(row[n]) for n in names) for row in spark_rows.collect()), key=repr)
    assert got == want
    return len(got)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_against_sql(spark, duck, name):
    same(catalog.QUERIES[name](spark, SF), duck, catalog.ORACLE_SQL[name])


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLE_SQL)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["kind", "qualified_name", "file_path", "depth"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
