import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from corvane.session import session

    s = session("local[4]", partitions=4, memory="3g")
    yield s
    s.stop()
