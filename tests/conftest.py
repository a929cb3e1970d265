import pytest

from tablewright.session import local_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session("8", 4)
    if session.sparkContext.getCheckpointDir() is None:
        session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield session
    session.stop()
