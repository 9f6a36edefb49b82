import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))


SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from sparkstats.session import local_session
    s = local_session("*", 8)
    yield s


@pytest.fixture(scope="session")
def con():
    from oracle import duck
    return duck(SF_SMALL)
