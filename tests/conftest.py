from __future__ import annotations

import pytest

from graphloom.session import get_spark


@pytest.fixture(scope="session")
def spark():
    s = get_spark("local[8]", shuffle_partitions=8)
    yield s
