import pytest

from strandwork.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "strandwork-tests")
    session.sparkContext.setLogLevel("ERROR")
    return session
