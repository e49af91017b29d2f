import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from scholarmill.session import get_spark

    session = get_spark(4, 4, "6g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
