from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    folder = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.warehouse.dir", str(folder / "warehouse"))
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


DATA = Path("/root/testdata")


@pytest.fixture(scope="session")
def tiny() -> str:
    """The smallest tables."""
    if not (DATA / "sf0.001").is_dir():
        pytest.skip("the driver's tables are not here")
    return str(DATA / "sf0.001")


@pytest.fixture(scope="session")
def small() -> str:
    if not (DATA / "sf0.01").is_dir():
        pytest.skip("the driver's tables are not here")
    return str(DATA / "sf0.01")
