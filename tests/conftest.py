import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from shelfsense.session import build_session

    session = build_session(
        "tests", "local[8]", spark__sql__shuffle__partitions=4, spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
        spark__driver__memory="8g",
    )
    session.sparkContext.setLogLevel("FATAL")
    yield session
    session.stop()
