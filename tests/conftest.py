import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from maskwright.session import local_session

    s = local_session("8", "tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def oracle_db():
    from oracle import connect

    return connect("/root/testdata/sf0.001")
