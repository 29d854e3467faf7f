"""Every query against its SQL on the smallest tables, and those without SQL for their rows."""

import duckdb
import pytest

from tidelane.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def close(a, b) -> bool:
    return a == b or isinstance(a, float) and isinstance(b, float) and abs(a - b) <= 1e-6 * max(1, abs(a), abs(b)) + 1.1e-6


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_equals_sql(spark, sf_dir, con, name):
    df = catalog.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    r = con.sql(catalog.oracle_sql()[name])
    assert sorted(r.columns) == columns
    at = [r.columns.index(c) for c in columns]
    want = sorted((tuple(x[i] for i in at) for x in r.fetchall()), key=repr)
    assert len(got) == len(want)
    assert [g for g, w in zip(got, want) if not all(map(close, g, w))] == []


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_has_stable_rows(spark, sf_dir, name):
    df = catalog.queries()[name](spark, sf_dir)
    rows = df.collect()
    assert all(len(r) == len(df.columns) for r in rows)
    if not name.startswith("strategy_") and "simulate" not in name:
        assert rows


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
