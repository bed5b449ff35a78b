from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from cardlens.session import get_session
    s = get_session("local[4]", shuffle_partitions=4, app_name="cardlens-tests")
    yield s
    s.stop()
