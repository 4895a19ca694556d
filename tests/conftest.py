import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from parcelight.session import local_session

    s = local_session(8, 4)
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def sf_dir():
    import os

    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
