import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

ROOT = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from tapeline.session import local_session

    s = local_session("4", "6g")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def root():
    return ROOT
