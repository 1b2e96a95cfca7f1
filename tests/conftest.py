from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from trailmark.session import get_spark

    s = get_spark(master="local[2]", shuffle_partitions=4, app_name="trailmark-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def small_dir() -> str:
    if not os.path.exists(f"{SF_SMALL}/events.parquet"):
        pytest.skip("test data not present")
    return SF_SMALL
