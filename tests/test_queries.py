"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import os

import pytest
from oracle import compare, duck

import __spark_entry__ as entry_module

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(entry_module.queries()))
def test_query(spark, con, name):
    verdict = compare(spark, con, name, entry_module.queries()[name], entry_module.oracle_sql().get(name), SF)
    assert verdict.startswith(("ok", "rows-only")), verdict


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
