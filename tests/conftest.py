import datetime
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from epilattice.session import local_session

    return local_session(os.environ.get("TEST_CPUS", "4"), "4g")


@pytest.fixture(scope="session")
def table(spark):
    """Rows and a schema string to a table."""
    return lambda rows, schema: spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def day():
    return lambda text: datetime.date.fromisoformat(text)
