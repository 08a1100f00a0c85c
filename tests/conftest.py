import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parents[1]), str(Path(__file__).resolve().parent)]

from seqloom.runtime import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = session("tests", cores="4", partitions=4, driver_memory="4g")
    yield s
    s.stop()


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SF
