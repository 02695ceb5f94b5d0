import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tests"))

from panel_helpers import t  # noqa: E402

from panelweave.operators.blocks import with_grid_slot  # noqa: E402
from panelweave.schemas import MEASUREMENTS_SCHEMA  # noqa: E402
from panelweave.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "2", "spark.driver.memory": "4g",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoint")), "spark.ui.showConsoleProgress": "false"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def panel(spark):
    """Build measurements from ``{pollutant: [(time, value), …]}``."""
    def build(cells, rate="H", station="S1"):
        rows = [(station, rate, t(when), p, None if v is None else float(v)) for p, points in cells.items() for when, v in points]
        return spark.createDataFrame(rows, MEASUREMENTS_SCHEMA)
    return build


@pytest.fixture(scope="session")
def daily(panel):
    times = ["2013-01-11 23:00:00", "2013-01-12 23:00:00", "2013-01-14 23:00:00"]
    return panel({"PM10": list(zip(times, [12, 19, 43])), "PM2.5": list(zip(times, [8, 13, 32]))}, "D")


@pytest.fixture(scope="session")
def hourly(panel):
    times = ["2013-01-01 00:00:00", "2013-01-01 01:00:00", "2013-01-01 03:00:00"]
    return panel({"NO": list(zip(times, [36.848, 42.785, 16.865])), "PM10": list(zip(times, [200.165, 205.237, 27.727])),
                  "SO2": list(zip(times, [27.458, 10.514, 4.948]))})


@pytest.fixture(scope="session")
def short(panel):
    """Gap-free series 1, 2, 4, 8 with slots."""
    return with_grid_slot(panel({"NO": [(f"2020-01-01 0{i}:00:00", v) for i, v in enumerate([1, 2, 4, 8])]}))
