"""The registered queries against their SQL, on whole tables."""

from __future__ import annotations

import pytest

from oracle import compare, connect
from strandloom.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, name):
    assert compare(spark, connect(sf_dir), queries.queries()[name], queries.oracle_sql()[name], sf_dir) == ""
