import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent.parent))

from check_queries import session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    spark = session(4)
    yield spark
    spark.stop()


@pytest.fixture
def path(tmp_path):
    return str(tmp_path)
