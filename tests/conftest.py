import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from papyrine.session import local_session  # noqa: E402

#: Started here, as columns at the top of test modules need a session.
SESSION = local_session("4", "4g", 4)


@pytest.fixture(scope="session")
def spark():
    return SESSION
