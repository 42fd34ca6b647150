"""Every registered query against its SQL twin on the smallest driver tables."""

import os

import pytest
import side_by_side

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


@pytest.fixture(scope="module")
def con():
    return side_by_side.connect(SF)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, con, name):
    status, _, _, note = side_by_side.compare(spark, con, SF, name, entry.queries()[name], entry.oracle_sql()[name])
    assert status == "ok", note


def test_names_are_paired():
    assert set(entry.oracle_sql()) <= set(entry.queries())
