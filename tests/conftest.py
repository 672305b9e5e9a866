import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from sparkcast.session import build_session, ship_package  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[8]", 4, "4g", "sparkcast-tests")
    ship_package(session)
    yield session
    session.stop()
