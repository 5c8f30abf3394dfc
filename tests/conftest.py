import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidemark.session import local_session, release_staged  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(8, memory="4g", partitions=4)


@pytest.fixture(autouse=True)
def _release():
    yield
    release_staged()
