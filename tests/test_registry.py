"""Every registered query against its SQL twin, on the smallest tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from compare import compare, duck  # noqa: E402
from curbline.checks import registry  # noqa: E402

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no tables")
QUERIES, TEXTS = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(TEXTS)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    verdict, _ = compare(spark, con, name, QUERIES[name], TEXTS.get(name), SF_DIR)
    assert verdict.startswith(("ok", "rows only")), verdict
    assert "TYPES" not in verdict, verdict
