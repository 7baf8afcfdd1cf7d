import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from sievestone.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("4", shuffle_partitions=4, memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
