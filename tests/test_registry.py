"""Every registered query against its SQL counterpart on the smallest tables."""

import os

import __spark_entry__ as contract
import duckdb
import pytest

from corpusmill.plans import registry


@pytest.fixture(scope="module")
def sql(sf_dir):
    connection = duckdb.connect()
    for name in os.listdir(sf_dir):
        connection.sql(f"create view {name.removesuffix('.parquet')} as select * from '{sf_dir}/{name}'")
    return connection


# Compared with the public library and plain walks in test_full_vocabulary.py: SQL is too slow for the whole vocabulary.
WITHOUT_SQL = {name.removeprefix("small_") for name in registry.QUERIES if name.startswith("small_")} | {"generated_previews"}


def test_every_other_query_has_a_counterpart():
    assert set(registry.ORACLE) == set(registry.QUERIES) - WITHOUT_SQL


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_equals_sql(spark, sf_dir, sql, name):
    table = contract.queries()[name](spark, sf_dir)
    expected = sql.sql(contract.oracle_sql()[name])
    assert sorted(table.columns) == sorted(expected.columns)
    columns = sorted(table.columns)
    places = [expected.columns.index(column) for column in columns]
    want = sorted((tuple(row[i] for i in places) for row in expected.fetchall()), key=repr)
    assert sorted((tuple(row[c] for c in columns) for row in table.collect()), key=repr) == want


def test_entry(spark):
    result = contract.entry(spark)
    assert result.columns == ["split", "doc_id", "sample_pos", "input_ids", "n_tokens"]
    row = result.first()
    assert len(row.input_ids) == 1080
