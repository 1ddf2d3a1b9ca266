import pytest

from tapeworks.session import local_session


def session():
    return local_session("8", name="tapeworks-tests")


@pytest.fixture(scope="session")
def spark():
    return session()
