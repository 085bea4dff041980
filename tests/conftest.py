import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from grainmill.session import build_session, ensure_importable

    session = build_session("tests", spark__master="local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__driver__memory="4g")
    ensure_importable(session)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
