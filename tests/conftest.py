import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from nearfold.session import local_session

    session = local_session("4", "6g")
    yield session
    session.stop()


@pytest.fixture
def store(spark, tmp_path):
    from nearfold.sources.store import RunStore

    return RunStore(spark, str(tmp_path / "store"))
