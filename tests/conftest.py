import pytest

from siftwell.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", 4, "tests")
    yield session
    session.stop()
