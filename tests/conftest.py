import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
os.environ["PYTHONPATH"] = os.pathsep.join(p for p in (ROOT, os.environ.get("PYTHONPATH", "")) if p)
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from lettersift.session import local_session

    s = local_session("4", 4, "3g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
