"""Every registered query equals its DuckDB oracle on the smallest data."""

from __future__ import annotations

import re

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.oracle_check import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


#: numbered queries and the pipeline belong to a subpackage that may be absent; which of them SQL
#: cannot express, and what they are held against instead, is stated and tested with them
NUMBERED = re.compile(r"op\d+_.*|pipeline")


def test_every_query_has_an_oracle():
    assert set(oracle_sql()) <= set(queries())
    assert {x for x in set(queries()) - set(oracle_sql()) if not NUMBERED.fullmatch(x)} == set()


@pytest.mark.parametrize("name", list(oracle_sql()))
def test_query_equals_oracle(spark, con, name):
    same, note = compare(spark, con, name, SF)
    assert same, note


def test_entry(spark):
    assert entry(spark).count() > 0
