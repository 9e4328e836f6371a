from __future__ import annotations

import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    builder = (
        SparkSession.builder.master("local[4]")
        .appName("panelwright-tests")
        .config("spark.sql.shuffle.partitions", "2")
        .config("spark.default.parallelism", "2")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="panelwright-tests-"))
    )
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def panel(spark):
    """Builds a panel from {place: {period: value}} or {place: [values from 2000 on]}."""

    def build(series, indicator="x", start=2000):
        rows = []
        for place, values in series.items():
            cells = values.items() if isinstance(values, dict) else enumerate(values, start)
            for period, value in cells:
                number = None if value is None else float(value)
                rows.append((indicator, place, int(period), str(period), number))
        return spark.createDataFrame(
            rows, "indicator_key string, place_id string, period int, date string, value double"
        )

    return build


@pytest.fixture(scope="session")
def indicators(spark):
    """One row of metadata for the indicator the panels use."""
    from panelwright.schema import literal_table

    def build(polarity="higher_is_better", ceiling=None, target=None, year=None, key="x", **more):
        denominator = more.get("denominator")
        start, end = more.get("start", "2000"), more.get("end", "2024")
        return literal_table(
            spark,
            [(key, polarity, ceiling, target, year, denominator, start, end)],
            "indicator_key string, polarity string, saturation_ceiling double, "
            "target_value double, target_year int, denominator string, temporal_start string, "
            "temporal_end string",
        )

    return build
