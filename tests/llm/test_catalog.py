"""Registered queries against their SQL over the small tables."""

from __future__ import annotations

from pathlib import Path

import pytest

import __spark_entry__ as entry
from paytally.llm import catalog, oracle
from tests.compare import compare, oracle_connection

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="benchmark tables are not here")


def test_every_operator_is_registered():
    names = set(entry.queries())
    assert "pipeline" in names
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 14))


@pytest.mark.parametrize("name", sorted(oracle.queries()))
def test_query(spark, name):
    problem, _ = compare(spark, oracle_connection(SF_DIR), catalog.queries()[name], oracle.queries()[name], SF_DIR)
    assert problem == ""
