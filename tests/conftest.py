import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tools")]


@pytest.fixture(scope="session")
def spark():
    from barloom.session import local_session
    s = local_session(4, "4g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
