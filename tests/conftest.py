import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from panelmill.session import get_spark
    s = get_spark(master="local[4]", shuffle_partitions=4)
    yield s
