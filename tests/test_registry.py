"""Every registered query against its SQL on the smallest tables."""

import math

import duckdb
import pytest

from wordtide import registry

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()
TYPES = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}


def rows_of(frame):
    def plain(value):
        if value is None or (isinstance(value, float) and math.isnan(value)):
            return ""
        return repr(value.item() if hasattr(value, "item") else value)

    columns = sorted(frame.columns)
    return sorted(tuple(plain(v) for v in row) for row in frame[columns].astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def duck(tiny):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{tiny}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(name, spark, tiny, duck):
    got = registry.queries()[name](spark, tiny)
    expected = duck.sql(registry.oracle_sql()[name])
    want = {c: TYPES[str(t)] for c, t in zip(expected.columns, expected.types)}
    assert dict(got.dtypes) == want
    assert rows_of(got.toPandas()) == rows_of(expected.df())


def test_every_sql_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())
