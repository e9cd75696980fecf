import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    from codeloom.session import local_session

    session = local_session("*", 8, "6g")
    yield session
    session.stop()
