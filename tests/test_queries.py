"""Every registered query against its SQL, on the smallest of the given tables."""

from functools import cache
from pathlib import Path

import compare
import pytest

from __spark_entry__ import entry
from folioscope.plans import fixtures
from folioscope.plans.oracle import ORACLE
from folioscope.plans.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="the given tables are not here")
# At this scale every labelled document also has an embedding, so none can vanish.
MAY_BE_EMPTY = {"vanished_documents"}


@pytest.fixture(scope="module")
def connection():
    return compare.connect(SF_DIR)


@pytest.fixture(scope="module", autouse=True)
def built_once():
    """The corpus is the same for every query, so the tests build it once."""
    patch = pytest.MonkeyPatch()
    patch.setattr(fixtures, "corpus", cache(fixtures.corpus))
    yield
    patch.undo()


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@needs_tables
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, connection, name):
    problem = compare.check(spark, connection, SF_DIR, name, QUERIES, ORACLE)
    assert problem is None or (problem == "no rows" and name in MAY_BE_EMPTY), problem


@needs_tables
def test_entry(spark):
    assert entry(spark).count() > 0
