"""Every query with SQL equals what DuckDB makes of it; the known figures of the derived views hold."""

import duckdb
import pytest

from riboplan import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    return c


def normal(rows, columns):
    at = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(str(float(r[i])) if isinstance(r[i], float) else str(r[i]) for i in at) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, con, data, name):
    df = catalog.queries()[name](spark, data)
    want = con.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert normal([tuple(r) for r in df.collect()], df.columns) == normal(want.fetchall(), columns)


def test_every_query_runs(spark, data):
    without = set(catalog.queries()) - set(catalog.oracle_sql())
    assert without == {"edit_distance_hw", "align_single", "align_pairs"}
    for name in without:
        assert catalog.queries()[name](spark, data).count() >= 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
