import pytest

from tidemark.llm import common


@pytest.fixture(autouse=True, scope="module")
def _release_tables():
    yield
    common.release()
