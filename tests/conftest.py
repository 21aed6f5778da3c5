import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent.parent))


@pytest.fixture(scope="session")
def spark():
    from lodestar import session

    s = session.local(4, partitions=4, memory="4g")
    yield s
    s.stop()
