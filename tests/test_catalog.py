"""Every catalogued query against its SQL, on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import pytest

import __spark_entry__ as entry
from paytally import catalog, oracle
from tests.compare import compare, oracle_connection

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="benchmark tables are not here")


@pytest.fixture(scope="module")
def connection():
    return oracle_connection(SF_DIR)


def test_every_query_has_an_oracle():
    assert set(catalog.queries()) == set(oracle.queries())
    assert set(catalog.queries()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, connection, name):
    problem, _ = compare(spark, connection, catalog.queries()[name], oracle.queries()[name], SF_DIR)
    assert problem == ""


def test_entry(spark):
    assert entry.entry(spark).count() > 0
