import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    os.environ.setdefault("RECSIFT_SCRATCH", tempfile.mkdtemp(prefix="recsift-tests-"))
    from recsift.session import build_session
    s = build_session("local[4]", 8)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def small_dir():
    return SF_SMALL
