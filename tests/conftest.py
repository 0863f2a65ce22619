import sys
from datetime import datetime, timedelta
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from checks.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", memory="6g", partitions="3")
    yield session
    session.stop()


@pytest.fixture
def at():
    """Time of day on the test day, from hh:mm or hh:mm:ss."""

    def parse(text):
        if text is None:
            return None
        parts = [int(p) for p in text.split(":")]
        return datetime(2024, 1, 10) + timedelta(hours=parts[0], minutes=parts[1], seconds=parts[2] if len(parts) > 2 else 0)

    return parse


@pytest.fixture
def alarms(spark, at):
    """Alarm frame from (ID, on, off, code, type[, station[, period]]) tuples."""

    def make(rows):
        data = []
        for row in rows:
            ident, on, off, code, kind, *rest = row
            station = rest[0] if rest else 1
            period = rest[1] if len(rest) > 1 else "2024-01"
            data.append((period, ident, at(on), at(off), station, code, "", kind, f"text {ident}", at(on), at(off)))
        return spark.createDataFrame(
            data,
            "period string, ID long, TimeOn timestamp_ntz, TimeOff timestamp_ntz, StationNr long, Alarmcode int, Parameter string, "
            "`Error Type` int, `UK Text` string, OldTimeOn timestamp_ntz, OldTimeOff timestamp_ntz",
        )

    return make
