import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def spark():
    from callsieve.session import local_session

    session = local_session(partitions=4)
    yield session
    session.stop()


@pytest.fixture
def folder(tmp_path):
    """A fresh local folder as a URI."""
    return f"file://{tmp_path}"
