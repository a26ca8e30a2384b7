"""Every registered query of the library against its SQL on DuckDB."""

import decimal
import math

import duckdb
import pytest

import __spark_entry__ as entry
from polyframe.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP"}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    return float(value) if isinstance(value, decimal.Decimal) else value


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    frame = QUERIES[name](spark, FOLDER)
    columns = sorted(frame.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in frame.collect()), key=repr)
    if name not in ORACLES:
        assert got
        return
    result = duck.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert {c: KINDS[k] for c, k in frame.dtypes} == {d[0]: str(d[1]) for d in result.description}
    assert got == sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=repr)


def test_entry(spark):
    frame = entry.entry(spark)
    assert frame.columns == ["n_name", "p_brand", "revenue", "place"]
    assert frame.count() > 0


def test_registry_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())
