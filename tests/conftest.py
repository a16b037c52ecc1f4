import pytest

from quireflow.runtime import clean, local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, 4)
    yield session
    clean(session)
    session.stop()
