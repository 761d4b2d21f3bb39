import os

import pytest

from tests.checking import connect

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf_dir():
    if not os.path.isdir(SF_DIR):
        pytest.skip("test tables not present")
    return SF_DIR


@pytest.fixture(scope="session")
def given(sf_dir):
    return connect(sf_dir)


@pytest.fixture
def documents(spark):
    """A frame of (doc_id, text), with columns whose names an operator uses itself."""

    def make(rows):
        schema = "doc_id long, text string, kept boolean, n long, a string, label int, source string"
        return spark.createDataFrame([(i, t, None, None, None, None, None) for i, t in rows], schema)

    return make
