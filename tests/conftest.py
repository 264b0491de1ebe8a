import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
# Python workers import the functions that tests pass as parsers and responders.
os.environ["PYTHONPATH"] = os.pathsep.join([str(ROOT), str(ROOT / "tests")])


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from doctriage.session import local_session

    folder = tmp_path_factory.mktemp("shared")
    session = local_session(8, 8, spark__checkpoint__dir=str(folder))
    yield session
    session.stop()
