import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from evidence_spark.session import local_session

    s = local_session(4, "tests")
    s.sparkContext.setLogLevel("ERROR")
    return s
