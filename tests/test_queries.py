"""Every registered query runs at the smallest scale and agrees with its SQL."""

import os

import pytest

from nightsieve import catalog
from tests.compare import connect, difference

FOLDER = os.environ.get("NIGHTSIEVE_TESTDATA", "/root/testdata/sf0.001")
CHECKED = sorted(catalog.checks())
UNCHECKED = sorted(set(catalog.queries()) - set(CHECKED))


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", CHECKED)
def test_agrees_with_sql(spark, con, name):
    problem = difference(name, catalog.queries()[name], catalog.checks()[name], spark, FOLDER, con)
    assert problem is None, problem


@pytest.mark.parametrize("name", UNCHECKED)
def test_runs(spark, name):
    df = catalog.queries()[name](spark, FOLDER)
    assert df.columns
    assert df.count() > 0


def test_every_check_has_a_query():
    assert set(catalog.checks()) <= set(catalog.queries())
