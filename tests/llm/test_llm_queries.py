"""The text queries against their SQL, and runs of the others."""

from __future__ import annotations

import pytest
from compare import differ
from conftest import DATA

from actaloom.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_against_sql(spark, name):
    assert not differ(spark, DATA, queries.QUERIES[name], queries.ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE)))
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, DATA).count() > 0
