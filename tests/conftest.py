import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from wirelark.session import get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = get_session(4, 4, spark__sql__autoBroadcastJoinThreshold="1m")
    yield s
    s.stop()
