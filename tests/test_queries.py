"""Every query of the library's own operators against its SQL over the smallest tables."""

import duckdb
import pytest

from lodestone import queries as library

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float) or type(x).__name__ == "Decimal":
        return round(float(x), 5)
    return tuple(x) if isinstance(x, list) else x


def rows_of(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(library.SQL))
def test_query_equals_sql(spark, sql, name):
    df = library.QUERIES[name](spark, SF)
    got = rows_of(df.collect(), df.columns)
    found = sql.execute(library.SQL[name])
    columns = [x[0] for x in found.description]
    assert sorted(df.columns) == sorted(columns)
    assert got == rows_of(found.fetchall(), columns)


@pytest.mark.parametrize("name", sorted(set(library.QUERIES) - set(library.SQL)))
def test_other_queries_run(spark, name):
    assert library.QUERIES[name](spark, SF).count() > 0
