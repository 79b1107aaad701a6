import pytest

from lamina.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "lamina-tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
