"""Every registered query of the geometry engine against its SQL on the smallest tables."""

import duckdb
import pytest
from conftest import SF

from feldspar.plans import catalog

NAMES = sorted(catalog.oracle_sql())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events embeddings".split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def tidy(frame):
    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted(tuple(round(v, 6) + 0.0 if isinstance(v, float) else v for v in r) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, duck, name):
    assert tidy(catalog.queries()[name](spark, SF).toPandas()) == tidy(duck.sql(catalog.oracle_sql()[name]).df())


def test_queries_without_sql(spark):
    for name in set(catalog.queries()) - set(NAMES):
        assert catalog.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
