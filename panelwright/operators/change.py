"""Change between observed periods, and the per-indicator thresholds taken from it.

Windows over one series (indicator, place) hold at most one row per calendar step, because a
panel has one cell per (indicator, place, period). Groups that span places have no such limit
and go through ``functions.order_stats``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions.order_stats import exact_quantiles, join_keys
from panelwright.schema import INDICATOR, MAD_TO_SIGMA, SERIES
from panelwright.staging import settle


def known(value: str | Column) -> Column:
    """Neither null nor NaN."""
    col = F.col(value) if isinstance(value, str) else value
    return col.isNotNull() & ~F.isnan(col)


def change_from_previous(panel: DataFrame, value: str = "value") -> DataFrame:
    """One row per cell that has an earlier observed cell in its series (the first has none).

    The earlier cell is the previous observed one, so a reporting gap gives one change over
    ``gap_years`` steps and no invented values in between.
    """
    series = Window.partitionBy(*SERIES).orderBy("period")
    rows = panel.where(known(value) & F.col("period").isNotNull()).select(
        *SERIES,
        "period",
        "date",
        F.col(value).alias("value"),
        F.lag("period").over(series).alias("_prior_period"),
        F.lag("date").over(series).alias("prior_date"),
        F.lag(value).over(series).alias("prior_value"),
    )
    return rows.where(F.col("_prior_period").isNotNull()).select(
        *SERIES,
        "period",
        "date",
        "value",
        "prior_date",
        "prior_value",
        (F.col("value") - F.col("prior_value")).alias("change"),
        (F.col("period") - F.col("_prior_period")).cast("bigint").alias("gap_years"),
    )


def with_own_scale(changes: DataFrame) -> DataFrame:
    """Adds each series' number of changes, their median and robust scale.

    Right after ``change_from_previous`` the rows are already partitioned by series, so this
    costs no shuffle; later it costs one.
    """
    series = Window.partitionBy(*SERIES)
    return (
        changes.withColumn("own_count", F.count("change").over(series))
        .withColumn("own_centre", F.median("change").over(series))
        .withColumn("_away", F.abs(F.col("change") - F.col("own_centre")))
        .withColumn("own_scale", F.lit(MAD_TO_SIGMA) * F.median("_away").over(series))
        .drop("_away")
    )


def robust_scale(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Median, 1.4826 x median absolute deviation and number of the known values per key."""
    keys = list(keys)
    # Read twice, for the middle and for the distances from it.
    df = settle(df.select(*keys, value))
    centre = exact_quantiles(df, keys, value, {"median": 0.5})
    return _around(df, centre, keys, value)


def _around(df: DataFrame, centre: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``centre``, a row per key with its ``median``, with the scale and number of the values."""
    # Small beside the rows it is read against, and written so that its size is known.
    centre = settle(centre)
    # Equal infinities are no distance apart.
    away = F.when(F.col(value) == F.col("median"), 0.0).otherwise(F.abs(F.col(value) - F.col("median")))
    rows = join_keys(df.select(*keys, value), centre, keys).select(*keys, away.alias("_away"))
    mad = exact_quantiles(rows, keys, "_away", {"_mad": 0.5}, count="n_values")
    scale = mad.select(*keys, (F.lit(MAD_TO_SIGMA) * F.col("_mad")).alias("scale"), "n_values")
    return join_keys(centre, scale, keys)


def change_scales(changes: DataFrame) -> DataFrame:
    """Per indicator: pooled scale of its changes, and the smallest change worth flagging.

    Indicators with fewer than two changes have no row. The result is written, so that joins
    with it know how small it is.
    """
    changes = settle(changes.select(INDICATOR, "change"))
    sizes = [F.struct(F.lit(x).alias("size"), c.alias("v")) for x, c in ((False, F.col("change")), (True, F.abs("change")))]
    both = changes.where(known("change")).select(INDICATOR, F.inline(F.array(*sizes)).alias("_size", "_value"))
    middle = exact_quantiles(both, [INDICATOR, "_size"], "_value", {"_half": 0.5, "_most": 0.9})
    centre = middle.groupBy(INDICATOR).agg(
        F.max(F.when(~F.col("_size"), F.col("_half"))).alias("median"),
        F.max(F.when(F.col("_size"), F.col("_most"))).alias("_p90"),
    )
    pooled = _around(changes, centre, [INDICATOR], "change")
    return settle(
        pooled.where(F.col("n_values") >= 2).select(
            INDICATOR,
            F.col("scale").alias("pooled_scale"),
            F.greatest("scale", "_p90").alias("magnitude_gate"),
            F.col("n_values").alias("n_changes"),
        )
    )
