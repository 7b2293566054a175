"""Every registered query beside its SQL twin, on the smallest tables."""

import os

import pytest

from compare import check, duck
from sievewatch.workloads import catalog

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables")
    return duck(FOLDER)


@pytest.mark.parametrize("name", list(catalog.jobs()))
def test_query(spark, con, name):
    ok, note = check(spark, con, FOLDER, name)
    assert ok, note


def test_twins_have_jobs():
    assert set(catalog.oracle()) <= set(catalog.jobs())
