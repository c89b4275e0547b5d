import math

import duckdb
import pytest

from matchlake.plans import catalog

TABLES = ("orders", "lineitem", "events", "pages")


def plain(v):
    return round(float(v), 6) if isinstance(v, float) or type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_its_sql(spark, sf_dir, name):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    rel = c.execute(catalog.ORACLE_SQL[name])
    columns = [d[0] for d in rel.description]
    df = catalog.QUERIES[name](spark, sf_dir)
    assert sorted(df.columns) == sorted(columns)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    want = sorted((tuple(plain(x) for x in r) for r in rel.fetchall()), key=key)
    got = sorted((tuple(plain(r[x]) for x in columns) for r in df.collect()), key=key)
    assert len(got) == len(want) > 0
    for a, b in zip(got, want, strict=True):
        assert all(x == y or isinstance(x, float) and math.isclose(x, y, rel_tol=1e-6, abs_tol=2e-6) for x, y in zip(a, b, strict=True)), (a, b)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 4
    assert set(e.oracle_sql()) <= set(e.queries())
