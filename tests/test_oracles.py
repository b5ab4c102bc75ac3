"""Each query of the reference's own operators gives the rows of its SQL on whole tables."""

from __future__ import annotations

import pytest

import lodestone.queries  # noqa: F401
from lodestone import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(name, same_as_sql):
    same_as_sql(registry.QUERIES[name], registry.ORACLE_SQL[name])
