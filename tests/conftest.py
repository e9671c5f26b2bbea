import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from brightweir import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = session.get_session("tests", "local[4]", 4)
    s.sparkContext.setLogLevel("ERROR")
    session.ship(s)
    return s
