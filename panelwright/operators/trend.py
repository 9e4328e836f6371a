"""Trend lines with autocorrelation-robust intervals, and progress toward targets.

All windows are over one series, so the fit needs a single shuffle on (indicator, place).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions import steps
from panelwright.functions.text import fixed
from panelwright.operators.change import known
from panelwright.schema import INDICATOR, NORMAL_975, SATURATION_TOLERANCE, SERIES

#: Last calendar year that a projection may reach, on the axis of any unit.
LAST_PROJECTED_YEAR = 2100


def is_saturated(
    latest: Column, ceiling: Column, tolerance: float = SATURATION_TOLERANCE
) -> Column:
    return latest >= ceiling - tolerance


def _series_fits(panel: DataFrame, value: str) -> DataFrame:
    """Fit sums of every series with a known value, and its latest value, null or not."""
    series = Window.partitionBy(*SERIES)
    ordered = series.orderBy("period")
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    x, y = F.col("period").cast("double"), F.col(value)
    rows = (
        panel.where(F.col("period").isNotNull())
        .withColumn("latest_value", F.last(value).over(whole))
        .where(known(value))
        .select(
            *SERIES,
            "period",
            "latest_value",
            (x - F.avg(x).over(series)).alias("_c"),
            (y - F.avg(y).over(series)).alias("_d"),
            F.avg(x).over(series).alias("_mean_x"),
            F.avg(y).over(series).alias("_mean_y"),
            F.regr_slope(y, x).over(series).alias("_slope"),
        )
        .withColumn("_g", F.col("_c") * (F.col("_d") - F.col("_slope") * F.col("_c")))
        .withColumn("_g1", F.lag("_g", 1).over(ordered))
        .withColumn("_g2", F.lag("_g", 2).over(ordered))
    )
    g = F.col("_g")
    return rows.groupBy(*SERIES).agg(
        F.count("*").alias("n_obs"),
        F.first("latest_value").alias("latest_value"),
        F.first("_slope").alias("slope"),
        F.first(F.col("_mean_y") - F.col("_slope") * F.col("_mean_x")).alias("intercept"),
        F.sum(F.col("_c") * F.col("_c")).alias("_sxx"),
        F.sum(g * g).alias("_s0"),
        F.coalesce(F.sum(g * F.col("_g1")), F.lit(0.0)).alias("_s1"),
        F.coalesce(F.sum(g * F.col("_g2")), F.lit(0.0)).alias("_s2"),
    )


def _intervals(fits: DataFrame) -> DataFrame:
    spread = F.col("_s0") + 2 * (F.col("_s1") * 2 / 3 + F.col("_s2") / 3)
    error = F.sqrt(F.greatest(spread, F.lit(0.0))) / F.nullif(F.col("_sxx"), F.lit(0.0))
    return (
        fits.where(F.col("n_obs") >= 3)
        .withColumn("_half", F.lit(NORMAL_975) * error)
        .select(
            *SERIES,
            "n_obs",
            "slope",
            (F.col("slope") - F.col("_half")).alias("slope_ci_low"),
            (F.col("slope") + F.col("_half")).alias("slope_ci_high"),
            "intercept",
            F.lit(False).alias("is_saturated"),
        )
    )


def fit_trends(panel: DataFrame, value: str = "value") -> DataFrame:
    """Least-squares line per series with a 95 % interval from Newey-West errors (two lags).

    With centred periods c and residuals u, the slope's variance is the Bartlett-weighted sum
    of the products of g = c*u with its two lags, over the squared sum of c^2. Lags count
    observations. Series with fewer than three observations have no row.
    """
    return _intervals(_series_fits(panel, value))


def fit_trends_excluding_saturated(
    panel: DataFrame, indicators: DataFrame, value: str = "value"
) -> tuple[DataFrame, DataFrame]:
    """(trends of the rest, the saturated series): none is dropped without being listed.

    A series is saturated when its latest cell, null or not, is at the indicator's ceiling.
    """
    ceilings = indicators.where(F.col("saturation_ceiling").isNotNull()).select(
        INDICATOR, "saturation_ceiling"
    )
    fits = _series_fits(panel, value).join(ceilings, INDICATOR, "left")
    full = F.coalesce(
        is_saturated(F.col("latest_value"), F.col("saturation_ceiling"))
        & known("latest_value"),
        F.lit(False),
    )
    saturated = fits.where(full).select(*SERIES, "latest_value", "saturation_ceiling")
    return _intervals(fits.where(~full)), saturated


def fitted_values(panel: DataFrame, trends: DataFrame) -> DataFrame:
    """Each observation with its place's trend line at that period."""
    line = trends.select(*SERIES, "slope", "intercept")
    return panel.join(line, SERIES).withColumn(
        "fitted", F.col("intercept") + F.col("slope") * F.col("period")
    )


def periods_to_target(
    latest: Column,
    latest_period: Column,
    slope: Column,
    target: Column,
    last_period: Column | int = LAST_PROJECTED_YEAR,
) -> Column:
    """Steps until the target at the present pace; infinite when never or beyond ``last_period``, a
    step on the series' own axis, and 0 when already there."""
    never = F.lit(math.inf)
    needed = (target - latest) / F.nullif(slope, F.lit(0.0))
    return (
        F.when(slope <= 0, never)
        .when(needed <= 0, F.lit(0.0))
        .when(latest_period + needed > last_period, never)
        .otherwise(needed)
    )


def _steady(x: Column) -> Column:
    """Twelve significant digits of a double: sums in another order give the same."""
    return F.when(F.abs(x) < math.inf, F.format_string("%.11e", x).cast("double")).otherwise(x)


def favourable_sign(polarity: Column) -> Column:
    return F.when(polarity == "lower_is_better", F.lit(-1.0)).otherwise(F.lit(1.0))


def progress(
    panel: DataFrame,
    indicators: DataFrame,
    trends: DataFrame | None = None,
    value: str = "value",
    last_year: int = LAST_PROJECTED_YEAR,
    horizon: int | None = None,
) -> DataFrame:
    """Per series: distance to the target, and when it was or will be reached.

    The unit of a series' steps is that of its latest date (years where ``panel`` has no dates).
    A projection ends with the last step of ``last_year`` or, if given, ``horizon`` steps ahead.
    Columns ``_period`` are steps, columns ``_year`` calendar years; a target counts to the last
    step of its year.

    A target met anywhere in the history counts from its first period; otherwise the pace of
    the fitted slope is carried forward. ``indicators`` gives polarity, target_value and
    target_year per indicator_key, the last two possibly null. Slopes and the steps ahead have
    twelve significant digits, so that no sum's order decides whether a projection stands on the
    last step of a year.
    """
    if trends is None:
        trends = fit_trends(panel, value)
    wanted = indicators.select(
        INDICATOR,
        favourable_sign(F.col("polarity")).alias("_sign"),
        F.col("target_value").cast("double").alias("target_value"),
        F.col("target_year").cast("int").alias("target_year"),
    )
    date = F.max_by("date", "period") if "date" in panel.columns else F.lit(None).cast("string")
    met = F.col("_sign") * F.col(value) >= F.col("_sign") * F.col("target_value")
    state = (
        panel.where(known(value) & F.col("period").isNotNull())
        .join(wanted, INDICATOR)
        .groupBy(*SERIES)
        .agg(
            F.max_by(value, "period").alias("latest_value"),
            F.max("period").alias("latest_period"),
            F.coalesce(steps.date_unit(date), F.lit(steps.YEAR)).alias("step_unit"),
            F.first("target_value").alias("target_value"),
            F.first("target_year").alias("target_year"),
            F.first("_sign").alias("_sign"),
            F.min(F.when(met, F.col("period"))).alias("_met"),
        )
        .join(trends.select(*SERIES, "slope"), SERIES, "left")
    )
    sign, target = F.col("_sign"), F.col("target_value")
    unit = F.col("step_unit")
    last = steps.last_step(F.lit(last_year), unit) if horizon is None else F.col("latest_period") + horizon
    ahead = periods_to_target(
        sign * F.col("latest_value"),
        F.col("latest_period"),
        sign * F.col("slope"),
        sign * target,
        last,
    )
    projected = (
        F.when(target.isNull(), F.lit(None))
        .when(F.col("_met").isNotNull(), F.col("_met").cast("double"))
        .when(F.col("slope").isNotNull(), F.col("latest_period") + _steady(ahead))
    )
    latest_year = F.floor(steps.calendar_year(F.col("latest_period"), unit)).cast("int")
    return state.withColumn("projected_period", projected).select(
        *SERIES,
        "latest_value",
        latest_year.alias("latest_year"),
        "latest_period",
        "step_unit",
        "target_value",
        "target_year",
        (sign * (target - F.col("latest_value"))).alias("gap"),
        _steady(F.col("slope")).alias("slope"),
        "projected_period",
        steps.calendar_year(F.col("projected_period"), unit).alias("projected_year"),
        (F.col("projected_period") <= steps.last_step(F.col("target_year"), unit)).alias("on_track"),
    )


def progress_table(results: DataFrame, names: DataFrame) -> DataFrame:
    """Display rows. A column that has nothing to show for an indicator is null throughout."""
    has_target = F.col("target_value").isNotNull()
    named = names.where(F.col("place_name") != "").select("place_id", "place_name")
    gap = (
        F.when(F.col("gap").isNull(), "—")
        .when(F.col("gap") <= 0, "Met")
        .otherwise(F.concat(fixed("gap", 1), F.lit(" remaining")))
    )
    year = F.col("projected_year")
    reaches = (
        F.when(year.isNull(), "—")
        .when(year == math.inf, "Not at current pace")
        .otherwise(fixed(year, 0))
    )
    track = (
        F.when(F.col("on_track").isNull(), "—")
        .when(F.col("on_track"), "✅ Yes")
        .otherwise("❌ No")
    )
    return results.join(named, "place_id", "left").select(
        *SERIES,
        F.coalesce("place_name", "place_id").alias("country"),
        "latest_year",
        fixed("latest_value", 1).cast("double").alias("latest"),
        F.when(has_target, gap).alias("gap_to_target"),
        F.when(has_target, reaches).alias("reaches_target"),
        F.when(F.col("target_year").isNotNull(), track).alias("on_track"),
    )
