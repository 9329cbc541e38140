import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from millrace.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", 4)
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def split_always(spark):
    """Force the bucketed and blocked paths that large tables take."""
    spark.conf.set("millrace.smallGroup", "0")
    spark.conf.set("millrace.rowsPerBucket", "40")
    yield
    spark.conf.unset("millrace.smallGroup")
    spark.conf.unset("millrace.rowsPerBucket")
