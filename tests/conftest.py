import pytest

from tests.session import session


@pytest.fixture(scope="session")
def spark():
    return session(cpus="4", memory="6g")
