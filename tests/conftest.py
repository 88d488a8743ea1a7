import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from vigilog.session import local_session  # noqa: E402

# Column expressions at the top of test modules need a running session.
_SESSION = local_session(4, shuffle_partitions=4)


@pytest.fixture(scope="session")
def spark():
    yield _SESSION
    _SESSION.stop()
