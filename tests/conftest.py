import sys
from datetime import datetime, timedelta
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tidemark.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, 4, "tests")
    yield session
    session.stop()


@pytest.fixture
def at():
    """Minutes after a fixed start as a naive UTC time."""
    return lambda minutes: datetime(2026, 1, 5) + timedelta(minutes=minutes)
