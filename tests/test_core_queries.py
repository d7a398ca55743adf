"""Every registered query of the core against its SQL twin; those without one must at least run."""

import importlib

import pytest
from conftest import SMALL, duck_rows, rows_of

import __spark_entry__ as entry

QUERIES = {k: v for m in entry._CORE for k, v in importlib.import_module(f"evispark.plans.{m}").QUERIES.items()}
SQL = {k: v for m in entry._CORE for k, v in importlib.import_module(f"evispark.plans.{m}").SQL.items()}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    got = rows_of(QUERIES[name](spark, SMALL))
    if name in SQL:
        assert got == duck_rows(SQL[name], SMALL)


def test_every_sql_has_its_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).columns == ["ref_table", "record_id", "claim_id", "reason"]
