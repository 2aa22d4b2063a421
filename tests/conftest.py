import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidemark.operators import ordered, quantiles  # noqa: E402
from tidemark.session import get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = get_session(
        "tests",
        "local[8]",
        spark__sql__shuffle__partitions="4",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="8g",
        spark__checkpoint__dir=tempfile.mkdtemp(prefix="tidemark-tests-"),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(params=["plain", "split"])
def path(request, monkeypatch):
    """Run a test on the path of small tables and on that of large ones."""
    if request.param == "split":
        monkeypatch.setattr(ordered, "PLAIN_ROWS", 0)
        monkeypatch.setattr(ordered, "BUCKET_ROWS", 17)
        monkeypatch.setattr(ordered, "BLOCK_ROWS", 16)
        monkeypatch.setattr(quantiles, "GROUP_CELLS", 8)
        monkeypatch.setattr(quantiles, "SKETCH", 100)
    return request.param


def series(n, start="2024-01-01", step=3600, fn=float, key=None):
    """Rows (ts, value) or (key, ts, value) at an even step."""
    import datetime

    base = datetime.datetime.fromisoformat(start)
    rows = [(base + datetime.timedelta(seconds=step * i), None if fn(i) is None else float(fn(i))) for i in range(n)]
    return rows if key is None else [(key, *r) for r in rows]


@pytest.fixture(scope="session")
def frame(spark):
    def make(rows, schema="ts timestamp, value double"):
        return spark.createDataFrame(rows, schema)

    return make
