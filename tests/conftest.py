import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from lexmill.session import session

    out = session("tests", cores=4, memory="4g", shuffle=4)
    out.sparkContext.setLogLevel("ERROR")
    return out
