import pytest

from specloom.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session(8, 4)
    yield s
    s.stop()
