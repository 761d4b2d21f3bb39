"""Every query against its SQL counterpart, on the smallest given tables."""

import os

import pytest

from __spark_entry__ import entry
from testbed.oracles import ORACLES
from testbed.queries import QUERIES

from .checking import connect, differences

SF_DIR = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not present")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    assert differences(QUERIES[name](spark, SF_DIR), con, ORACLES[name]) is None


def test_entry(spark):
    assert entry(spark).columns == ["ISSUE_TYPE", "RULE_NAME", "SEVERITY", "ISSUE_COUNT"]
