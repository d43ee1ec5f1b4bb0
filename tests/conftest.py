"""A small local session shared by all tests."""

from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from hippolake.session import session

    found = session(4, **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g"})
    found.sparkContext.setLogLevel("ERROR")
    return found


@pytest.fixture(scope="session")
def small() -> str:
    return SMALL
