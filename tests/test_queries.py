"""Every query against its SQL at the smallest scale."""

import os

import pytest

from tamiz.queries import QUERIES, SQL
from tests.check import compare, database

FOLDER = os.environ.get("TAMIZ_TESTDATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables")
    return database(FOLDER)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, db, name):
    rows, verdict = compare(spark, db, FOLDER, name)
    assert verdict == "ok"


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
