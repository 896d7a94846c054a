import os
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [os.path.dirname(HERE), HERE]


@pytest.fixture(scope="session")
def spark():
    import compare
    from tradeloom.session import tune_session

    s = tune_session(compare.session())
    yield s
    s.stop()
