from __future__ import annotations

import pytest

from oracle import compare, connect
from strandloom.plans import catalog


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(catalog.oracles()))
def test_query_equals_sql(spark, con, sf_dir, name):
    assert compare(spark, con, catalog.queries()[name], catalog.oracles()[name], sf_dir) == ""


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracles())))
def test_query_runs(spark, sf_dir, name):
    assert catalog.queries()[name](spark, sf_dir).count() > 0


def test_entry(spark, sf_dir):
    assert catalog.entry(spark, sf_dir).count() > 0
