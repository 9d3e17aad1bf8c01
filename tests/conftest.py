import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from driftloom.session import session, ship

    s = session("8", 4)
    s.sparkContext.setLogLevel("ERROR")
    yield ship(s)
    s.stop()
