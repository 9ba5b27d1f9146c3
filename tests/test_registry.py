"""Every registered query with SQL against DuckDB on the smallest tables."""

import math

import pytest

from quern.plans import fixtures, registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(frame):
    def plain(x):
        if x is None or isinstance(x, float) and math.isnan(x) or str(x) in ("NaT", "<NA>"):
            return None
        return round(float(x), 5) + 0.0 if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)

    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(str([plain(x.item() if hasattr(x, "item") else x) for x in r]) for r in frame.values.tolist())


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    if name not in registry.ORACLES:
        assert len(got)
        return
    want = duck.execute(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", list(fixtures.QUERIES))
def test_fixture(spark, duck, name):
    got, want = fixtures.QUERIES[name](spark, SF).toPandas(), duck.execute(fixtures.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert not set(registry.QUERIES) & set(fixtures.QUERIES)
    assert set(registry.QUERIES) | set(fixtures.QUERIES) <= set(entry.queries()) and set(registry.ORACLES) <= set(entry.oracle_sql())
    assert entry.entry(spark).count() > 0
