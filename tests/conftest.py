import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from kinoframe.session import build_session
    s = build_session(master="local[*]", shuffle_partitions=8, app="kinoframe-tests")
    yield s
    s.stop()
