"""Every registered query of the library against its SQL in DuckDB, on the smallest tables."""

import datetime
import decimal
import math

import duckdb
import pytest

from loomstone.plans import registry
from loomstone.tables import Tables

registry.queries()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_as_sql(name, spark, sf, duck):
    df = registry.PLANS[name](Tables(spark, sf))
    names = sorted(df.columns)
    mine = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    found = duck.execute(registry.SQL[name])
    theirs_names = [d[0] for d in found.description]
    assert sorted(theirs_names) == names
    theirs = sorted((tuple(plain(r[theirs_names.index(c)]) for c in names) for r in found.fetchall()), key=repr)
    assert mine == theirs
    assert mine or name not in ("vec_pair_clones", "clone_types", "causal_lift")


@pytest.mark.parametrize("name", sorted(set(registry.PLANS) - set(registry.SQL)))
def test_without_sql_gives_rows(name, spark, sf):
    assert registry.PLANS[name](Tables(spark, sf)).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 20
    assert set(e.oracle_sql()) <= set(e.queries())
