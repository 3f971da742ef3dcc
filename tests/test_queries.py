"""Every registered query against its SQL twin on the smallest scale."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from ashlar import registry

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "NULL"
    if isinstance(value, float):
        return repr(round(value, 6))
    return str(value)


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(v[i]) for i in order) for v in values)


#: Truth values that the tables give only one of at this size, with what decides them.
ONE_SIDED: dict[tuple[str, str], str] = {}


def says_something(name, columns, kinds, found):
    """A result has rows, and a truth value comes out both ways."""
    assert found, f"{name} returns nothing"
    for i, (column, kind) in enumerate(zip(columns, kinds)):
        if kind == "boolean" and (name, column) not in ONE_SIDED:
            assert {True, False} <= {r[i] for r in found}, f"{name}.{column} is {found[0][i]} in all rows"


@pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_sql(name, spark, duck):
    got = registry.QUERIES[name](spark, str(DATA))
    held = [tuple(r) for r in got.collect()]
    found = duck.execute(registry.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, held) == rows(names, found.fetchall())
    says_something(name, got.columns, [k for _, k in got.dtypes], held)


@pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(name, spark):
    got = registry.QUERIES[name](spark, str(DATA))
    says_something(name, got.columns, [k for _, k in got.dtypes], [tuple(r) for r in got.collect()])


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(registry.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
