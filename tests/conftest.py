import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from trawl.session import build_session, checkpoint_dir  # noqa: E402

SF = os.environ.get("TRAWL_TEST_SF", "/root/testdata/sf0.01")
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[8]", "trawl-tests", shuffle_partitions=8)
    checkpoint_dir(s)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF
