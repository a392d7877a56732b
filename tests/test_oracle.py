"""Every registered query against its SQL twin, value by value."""

import os

import duckdb
import pytest

from __spark_entry__ import entry
from retail_spark.plans import registry, streams  # noqa: F401  (streams adds its queries)

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLE = registry.QUERIES, registry.ORACLE
TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "string": "VARCHAR",
    "double": "DOUBLE",
    "timestamp_ntz": "TIMESTAMP",
    "boolean": "BOOLEAN",
}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in os.listdir(FOLDER):
        connection.execute(f"create view {name.removesuffix('.parquet')} as select * from '{FOLDER}/{name}'")
    return connection


def plain(value):
    return round(value, 6) if isinstance(value, float) else value


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_same_rows_as_sql(spark, duck, key):
    df = QUERIES[key](spark, FOLDER)
    names = sorted(df.columns)
    ours = sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr)
    result = duck.execute(ORACLE[key])
    columns = {c[0]: (i, str(c[1])) for i, c in enumerate(result.description)}
    theirs = sorted((tuple(plain(r[columns[n][0]]) for n in names) for r in result.fetchall()), key=repr)
    assert names == sorted(columns)
    assert {n: TYPES[df.schema[n].dataType.simpleString()] for n in names} == {n: columns[n][1] for n in names}
    assert ours == theirs


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLE)


def test_entry(spark):
    assert entry(spark).count() == 5
