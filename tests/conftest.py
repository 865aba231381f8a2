"""One local session for all tests."""

import pytest

from quern.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", partitions=4, app="quern-tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
