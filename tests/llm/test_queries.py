"""Numbered queries have SQL, or are stated not to have and tested otherwise."""

from __future__ import annotations

import importlib.util

from patchwell.llm import oracles, queries


def test_every_query_has_sql_or_a_test_of_its_own():
    assert set(oracles.oracle_sql()) | set(oracles.WITHOUT_SQL) == set(queries.QUERIES)
    assert not set(oracles.oracle_sql()) & set(oracles.WITHOUT_SQL)
    for module in oracles.WITHOUT_SQL.values():
        assert importlib.util.find_spec(f"tests.llm.{module}") is not None
