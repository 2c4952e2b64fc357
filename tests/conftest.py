import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from barlab.session import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = session("tests", "local[8]", 8)
    s.sparkContext.setLogLevel("ERROR")
    return s
