"""Steps of dates, long ids and signs of zero."""

import pytest
from pyspark.sql import functions as F

from panelwright.functions import ids, steps, text
from panelwright.operators import quality, trend
from panelwright.sources.observations import period_of


@pytest.mark.parametrize(
    "date, step",
    [("2020", 2020), ("-44", -44), ("2020-05", 24244), ("2020-06-01", 18414), ("2020-06-02", 18415),
     ("2020-13", None), ("2020-02-30", None), ("20230115", 19372), ("2020-Q3", 8082), ("2020Q1", 8080), ("2020-Q5", None), ("20231301", None), ("spring", None), ("", None), (None, None)],
)
def test_each_date_has_a_step_of_its_own(spark, date, step):
    df = spark.createDataFrame([(date,)], "date string")
    assert df.select(period_of(F.col("date"))).first()[0] == step


@pytest.mark.parametrize(
    "date, period, unit, step, back",
    [("2020", None, "year", 2020, "2020"), ("2020-05", None, "month", 24244, "2020-05"), ("2020-Q4", None, "quarter", 8083, "2020-Q4"),
     ("2020-02-29", "P1D", "day", 18321, "2020-02-29"), ("20200229", None, "day", 18321, "2020-02-29"), ("2020-05", "P3M", "quarter", 8081, "2020-Q2"),
     ("2020-12-31", "P1Y", "year", 2020, "2020"), ("2020", "P1M", "year", 2020, "2020"), ("0001-01", None, "month", 12, "0001-01"),
     ("-44", "P1Y", "year", -44, "-44"), ("soon", "P1Y", None, None, None), (None, "P1M", None, None, None)],
)
def test_units_steps_and_the_way_back(spark, date, period, unit, step, back):
    df = spark.createDataFrame([(date, period)], "date string, p string").select(
        steps.unit_of(F.col("date"), F.col("p")).alias("unit"), "date"
    )
    df = df.withColumn("step", steps.step_of(F.col("date"), F.col("unit")))
    row = df.select("unit", "step", steps.date_of(F.col("step"), F.col("unit")).alias("back")).first()
    assert tuple(row) == (unit, step, back)


def test_an_indicator_has_one_axis_and_the_rest_is_reported(spark):
    rows = [("m", "A", "2020-01"), ("m", "A", "2020-02"), ("m", "B", "2020"), ("m", "B", "soon"), ("t", "A", "2020"), ("t", "A", "2020-03"),
            (None, "A", "2020-Q1"), ("bad", "A", "soon"), ("bad", "A", None)]
    df = spark.createDataFrame([(k, p, -1, d, 1.0) for k, p, d in rows], "indicator_key string, place_id string, period int, date string, value double")
    found = quality.one_step_unit(df)
    assert {r.indicator_key: r.step_unit for r in found.units.collect()} == {"m": "month", "t": "year", None: "quarter"}
    kept = sorted((r.indicator_key or "", r.period, r.step_unit) for r in found.panel.collect())
    assert kept == [("", 8080, "quarter"), ("m", 24240, "month"), ("m", 24241, "month"), ("t", 2020, "year")]
    told = sorted((r.indicator_key, r.code, r.message.split()[0]) for r in found.findings.collect())
    assert told == [("bad", "UNREADABLE_DATE", "2"), ("m", "MIXED_STEPS", "1"), ("m", "UNREADABLE_DATE", "1"), ("t", "MIXED_STEPS", "1")]


@pytest.mark.parametrize(
    "dates, year, track, projected",
    [([f"{2000 + i}" for i in range(5)], 2006, True, 2006), ([f"2020-{i + 1:02d}" for i in range(5)], 2020, True, 2020 + 6 / 12),
     ([f"{2020 + i // 4}-Q{i % 4 + 1}" for i in range(5)], 2021, True, 2021.5), ([f"2020-12-{i + 27:02d}" for i in range(5)], 2020, False, 2021)],
)
def test_progress_on_every_axis(spark, indicators, dates, year, track, projected):
    df = spark.createDataFrame([("x", "A", d, 10.0 * i) for i, d in enumerate(dates)], "indicator_key string, place_id string, date string, value double")
    df = df.withColumn("period", period_of(F.col("date")))
    (r,) = trend.progress(df, indicators(target=60.0, year=year)).collect()
    assert r.projected_period - r.latest_period == pytest.approx(2) and r.on_track == track
    assert r.projected_year == pytest.approx(projected, abs=0.01) and r.latest_year == int(dates[-1][:4])
    (r,) = trend.progress(df, indicators(target=60.0, year=year), horizon=1).collect()
    assert r.projected_period == float("inf") and not r.on_track
    (r,) = trend.progress(df, indicators(target=1e9, year=year)).collect()
    assert r.projected_period == float("inf")


def test_long_ids_stay_whole(spark):
    df = spark.createDataFrame([("worldbank/" + "x" * 150_000,)], "v string")
    assert df.select(F.length(ids.id_code(F.col("v")))).first()[0] == 150_000


def test_zero_has_one_sign(spark):
    df = spark.createDataFrame([(-0.0,), (0.0,), (1.5,), (-1.5,)], "x double")
    assert [r[0] for r in df.select(text.signed("x", 1)).collect()] == ["+0.0", "+0.0", "+1.5", "-1.5"]
