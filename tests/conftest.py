import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from logweir.session import build_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[4]", "tests", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__driver__memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def ev(spark):
    """ev([(ts, offset), ...]) -> events of service svc, partition 0."""
    from logweir.schema import LOG_SCHEMA

    def make(pairs, service="svc", message="m"):
        return spark.createDataFrame([(t, "INFO", service, message, 0, o, "{}") for t, o in pairs], LOG_SCHEMA)

    return make
