from __future__ import annotations

import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from larderflow.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "local[8]",
        "larderflow-tests",
        spark__sql__shuffle__partitions="8",
        spark__ui__enabled="false",
        spark__driver__memory="8g",
        spark__checkpoint__dir=os.environ.get("SHARED_DIR") or tempfile.mkdtemp(prefix="larderflow-tests-"),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
