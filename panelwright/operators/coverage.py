"""Where a panel has holes, how stale it is, and how it meets geometry and other indicators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.functions.order_stats import top_per_key
from panelwright.schema import INDICATOR, SERIES


def _with_range(series: DataFrame, indicators: DataFrame) -> DataFrame:
    span = indicators.select(
        INDICATOR,
        F.col("temporal_start").cast("int").alias("_start"),
        F.col("temporal_end").cast("int").alias("_end"),
    )
    return series.join(span, INDICATOR)


def latest_by_place(panel: DataFrame) -> DataFrame:
    return panel.groupBy(*SERIES).agg(F.max("period").alias("latest_period"))


def coverage_report(panel: DataFrame, indicators: DataFrame, clip: bool = False) -> DataFrame:
    """Cells present against places x periods of the indicator's own range.

    Cells outside the range count as observed, so the missing number can turn negative;
    ``clip=True`` leaves them out. A cell with a null value counts as observed.
    """
    seen = F.array_intersect("_span", "_seen") if clip else F.col("_seen")
    per_place = _periods_seen(panel, indicators).select(
        INDICATOR, F.size(seen).alias("_cells"), F.size("_span").alias("_steps")
    )
    expected = F.col("n_places_total") * F.col("_steps")
    return (
        per_place.groupBy(INDICATOR)
        .agg(
            F.count("*").alias("n_places_total"),
            F.first("_steps").alias("_steps"),
            F.sum("_cells").alias("n_place_years_observed"),
        )
        .withColumn("n_place_years_expected", expected)
        .withColumn(
            "n_missing_cells", F.col("n_place_years_expected") - F.col("n_place_years_observed")
        )
        .select(
            INDICATOR,
            "n_places_total",
            "n_place_years_expected",
            "n_place_years_observed",
            "n_missing_cells",
            F.coalesce(
                F.col("n_missing_cells") / F.nullif("n_place_years_expected", F.lit(0)), F.lit(0.0)
            ).alias("missing_share"),
        )
    )


def stalest_places(panel: DataFrame, n: int = 10) -> DataFrame:
    """The places whose latest cell is oldest, oldest first, ties by place."""
    order = [F.asc("latest_period"), F.asc("place_id")]
    return top_per_key(latest_by_place(panel), [INDICATOR], order, n, "position")


def _periods_seen(panel: DataFrame, indicators: DataFrame) -> DataFrame:
    # The set of a series' periods is limited by the calendar, not by the size of the panel.
    series = panel.groupBy(*SERIES).agg(F.collect_set("period").alias("_seen"))
    span = F.when(
        F.col("_start") <= F.col("_end"), F.sequence(F.col("_start"), F.col("_end"))
    ).otherwise(F.array().cast("array<int>"))
    return _with_range(series, indicators).withColumn("_span", span)


def coverage_grid(panel: DataFrame, indicators: DataFrame) -> DataFrame:
    """Long place x period grid over the expected range: observed 1 or 0."""
    cells = F.concat(
        F.transform(
            F.array_intersect("_span", "_seen"),
            lambda p: F.struct(p.alias("period"), F.lit(1).alias("observed")),
        ),
        F.transform(
            F.array_except("_span", "_seen"),
            lambda p: F.struct(p.alias("period"), F.lit(0).alias("observed")),
        ),
    )
    return _periods_seen(panel, indicators).select(*SERIES, F.inline(cells))


def coverage_grid_wide(grid: DataFrame, periods: list[int]) -> DataFrame:
    """The grid with one column per listed period."""
    return grid.groupBy(*SERIES).pivot("period", periods).agg(F.max("observed"))


def missing_cells(panel: DataFrame, indicators: DataFrame) -> DataFrame:
    """The holes of the grid as rows, keyed on place id (names may collide)."""
    return _periods_seen(panel, indicators).select(
        *SERIES, F.explode(F.array_except("_span", "_seen")).alias("period")
    )


def write_missing_cells(missing: DataFrame, path: str) -> None:
    missing.write.mode("overwrite").option("header", True).csv(path)


def audit_join(panel: DataFrame, geometry: DataFrame) -> DataFrame:
    """Per indicator: places with and without geometry; clean when none is without."""
    places = panel.select(*SERIES).distinct()
    shapes = geometry.select("place_id").distinct()
    n_geometries = shapes.agg(F.count("*")).scalar()
    matched = F.count(F.when(F.col("_drawn"), 1))
    return (
        places.join(shapes.withColumn("_drawn", F.lit(True)), "place_id", "left")
        .groupBy(INDICATOR)
        .agg(F.count("*").alias("n_observations"), matched.alias("n_matched"))
        .select(
            INDICATOR,
            "n_observations",
            n_geometries.alias("n_geometries"),
            "n_matched",
            (F.col("n_observations") == F.col("n_matched")).alias("is_clean"),
        )
    )


def unmatched_places(panel: DataFrame, geometry: DataFrame) -> DataFrame:
    """Places with data that no geometry can draw."""
    return (
        panel.select(*SERIES).distinct().join(geometry.select("place_id"), "place_id", "left_anti")
    )


def unmatched_geometry(panel: DataFrame, geometry: DataFrame) -> DataFrame:
    """Geometries no indicator of ``panel`` has data for."""
    return geometry.select("place_id").distinct().join(
        panel.select("place_id").distinct(), "place_id", "left_anti"
    )


def coverage_asymmetry(left: DataFrame, right: DataFrame) -> DataFrame:
    """Places only one of two indicators has, as rows with their side."""
    l, r = left.select("place_id").distinct(), right.select("place_id").distinct()
    return (
        l.join(r, "place_id", "left_anti")
        .withColumn("side", F.lit("left_only"))
        .unionByName(
            r.join(l, "place_id", "left_anti").withColumn("side", F.lit("right_only"))
        )
    )


def coverage_asymmetries(panel: DataFrame, pairs: DataFrame) -> DataFrame:
    """Places that only one indicator of a pair has, for all asked pairs (left_key, right_key) at once.

    Every place of a pair is one row of an aggregate that combines before the shuffle, so work
    grows with what the asked indicators have. A pair of an indicator with itself has none.
    """
    have = panel.select(INDICATOR, "place_id").distinct()
    asked = pairs.select("left_key", "right_key").distinct()
    sides = F.inline(F.array(
        F.struct(F.col("left_key").alias("key"), F.lit(True).alias("left")),
        F.struct(F.col("right_key").alias("key"), F.lit(False).alias("left")),
    )).alias("_key", "_left")
    told = asked.select("left_key", "right_key", sides).join(have, F.col("_key") == F.col(INDICATOR))
    both = told.groupBy("left_key", "right_key", "place_id").agg(
        F.bool_or("_left").alias("_in_left"), F.bool_and("_left").alias("_only_left")
    )
    side = F.when(F.col("_only_left"), "left_only").when(~F.col("_in_left"), "right_only")
    return both.select("left_key", "right_key", "place_id", side.alias("side")).where(F.col("side").isNotNull())


def coverage_asymmetry_finding(left: DataFrame, right: DataFrame) -> DataFrame:
    only = coverage_asymmetry(left, right).agg(
        F.count(F.when(F.col("side") == "left_only", 1)).alias("n_left_only"),
        F.count(F.when(F.col("side") == "right_only", 1)).alias("n_right_only"),
    )
    return only.select(
        F.lit("info").alias("level"),
        F.lit("COVERAGE_ASYMMETRY").alias("code"),
        F.format_string(
            "%d places only on the left, %d only on the right", "n_left_only", "n_right_only"
        ).alias("message"),
        F.to_json(F.struct("n_left_only", "n_right_only")).alias("evidence"),
    )
