import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pitchside.session import build_session

    session = build_session("tests", cores="4", spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("wh")))
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
