"""Every registered query equals its SQL on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tools.compare import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    got = {r["metric"]: r["value"] for r in entry.entry(spark).collect()}
    assert got["Total Population"] == 150
    assert 0 < got["SCD Cases"] <= 150


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    equal, message = compare(spark, con, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert equal, message
