import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from sheetwise.session import get_session
    s = get_session("local[4]", "sheetwise-tests", shuffle_partitions=4,
                    checkpoint_dir=tempfile.mkdtemp(prefix="sheetwise-test-ckpt-"))
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR
