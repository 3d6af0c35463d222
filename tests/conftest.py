import os
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

from dataloupe.plans import quantiles  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[*]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(params=["short", "long"])
def plans(request, monkeypatch):
    """Runs a test twice: with sorted lists for short groups, and with brackets for all groups."""
    if request.param == "long":
        monkeypatch.setattr(quantiles, "SHORT_GROUP", 0)
    yield request.param


@pytest.fixture
def long_groups(monkeypatch):
    monkeypatch.setattr(quantiles, "SHORT_GROUP", 0)


@pytest.fixture(scope="session")
def frame(spark):
    """A frame from columns of Python values, with a DDL schema."""

    def build(schema: str, rows: list[tuple]):
        return spark.createDataFrame(rows, schema)

    return build
