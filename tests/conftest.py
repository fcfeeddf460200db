from __future__ import annotations

import os
import sys
from datetime import datetime, timedelta

import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from brimwatch.session import local_session  # noqa: E402

START = datetime(2026, 4, 1)
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, memory="6g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def series(spark):
    """Telemetry rows of named series: {host: values}, five minutes apart."""

    def build(values, minutes=5, device="/"):
        parts = [
            pd.DataFrame(
                {
                    "ts": [START + timedelta(minutes=minutes * i) for i in range(len(numbers))],
                    "host_id": host,
                    "device": device,
                    "in_use_pct": [round(float(v), 3) for v in numbers],
                }
            )
            for host, numbers in values.items()
        ]
        schema = "ts timestamp, host_id string, device string, in_use_pct double"
        return spark.createDataFrame(pd.concat(parts), schema)

    return build


@pytest.fixture(scope="session")
def data():
    if not os.path.isdir(DATA):
        pytest.skip("sample tables are not there")
    return DATA
