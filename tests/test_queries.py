"""Every registered query against its SQL on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from weft import catalog

DATA = Path("/root/testdata/sf0.001")
SLOW = {"msa_hier"}


def value(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6) + 0.0
    return round(float(x), 6) if type(x).__name__ == "Decimal" else x


@pytest.fixture(scope="module")
def tables():
    db = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        db.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return db


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - SLOW))
def test_query(spark, tables, name):
    df = catalog.queries()[name](spark, str(DATA))
    rows = [tuple(value(x) for x in r) for r in df.collect()]
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    found = tables.sql(sql)
    assert sorted(found.columns) == sorted(df.columns)
    order = [found.columns.index(c) for c in df.columns]
    want = [tuple(value(r[i]) for i in order) for r in found.fetchall()]
    assert sorted(rows, key=repr) == sorted(want, key=repr)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
