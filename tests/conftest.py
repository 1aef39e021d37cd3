import pytest

from binweave.runtime import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session(8, 4)
