from __future__ import annotations

import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from registry.compare import connect  # noqa: E402
from registry.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"
MIDDLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "8g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def con():
    return connect(MIDDLE)


def sec(text: str) -> int:
    h, m, s = (int(part) for part in text.split(":"))
    return h * 3600 + m * 60 + s


@pytest.fixture(scope="session")
def arrivals(spark):
    """Builds arrival rows from (client, fund, ticker, day of January 2024, time)."""

    def build(rows):
        return spark.createDataFrame(
            [
                (client, fund, ticker, dt.date(2024, 1, day), sec(time))
                for client, fund, ticker, day, time in rows
            ],
            "client_name string, fund_id string, ticker string, nav_date date, sec int",
        )

    return build
