import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from quarry.session import get_spark
    s = get_spark("local[4]", shuffle_partitions=8)
    yield s


@pytest.fixture
def df(spark):
    """Build a small DataFrame from rows and a DDL schema string."""
    def make(rows, schema):
        return spark.createDataFrame(rows, schema)
    return make
