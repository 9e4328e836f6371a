"""Beta-convergence: do places that started low gain more."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.functions.order_stats import exact_quantiles, join_keys, top_per_key
from panelwright.functions.student_t import t_975_column
from panelwright.operators.change import known
from panelwright.schema import INDICATOR, SATURATION_TOLERANCE, SERIES
from panelwright.staging import settle

MIN_PLACES = 5
LOW_COVERAGE = 0.8


def series_endpoints(panel: DataFrame) -> DataFrame:
    """First and last period present per indicator, written: it is joined with the whole panel."""
    return settle(
        panel.groupBy(INDICATOR).agg(
            F.min("period").alias("base_period"), F.max("period").alias("end_period")
        )
    )


def endpoint_values(
    panel: DataFrame, endpoints: DataFrame, value: str = "value"
) -> tuple[DataFrame, DataFrame]:
    """(places with both endpoint values, places lacking a value at one they report).

    One conditional aggregation over the two periods, written once for all that reads it.
    Missing values cannot enter the fit; the places they belong to are returned as well.
    """
    ends = panel.join(endpoints, INDICATOR).where(
        (F.col("period") == F.col("base_period")) | (F.col("period") == F.col("end_period"))
    )
    base = F.col("period") == F.col("base_period")
    end = F.col("period") == F.col("end_period")
    both = (
        ends.groupBy(*SERIES)
        .agg(
            F.max(base).alias("_has_base"),
            F.max(end).alias("_has_end"),
            F.max(F.when(base & known(value), F.col(value))).alias("base_value"),
            F.max(F.when(end & known(value), F.col(value))).alias("end_value"),
        )
        .where(F.col("_has_base") & F.col("_has_end"))
        .select(*SERIES, "base_value", "end_value")
    )
    both = settle(both)
    complete = F.col("base_value").isNotNull() & F.col("end_value").isNotNull()
    columns = [*SERIES, "base_value", "end_value"]
    places = both.where(complete).select(
        *columns, (F.col("end_value") - F.col("base_value")).alias("change")
    )
    return places, both.where(~complete).select(*columns)


def convergence(
    places: DataFrame,
    indicators: DataFrame,
    tolerance: float = SATURATION_TOLERANCE,
    all_places: DataFrame | None = None,
) -> DataFrame:
    """Change on base value per indicator, with a classical 95 % interval.

    ``all_places`` (the panel) adds the share of places the fit covers and a flag below 80 %.
    """
    near = (F.col("base_value") >= F.col("saturation_ceiling") - tolerance) | (
        F.col("end_value") >= F.col("saturation_ceiling") - tolerance
    )
    x, y = F.col("base_value"), F.col("change")
    fit = (
        places.join(indicators.select(INDICATOR, "saturation_ceiling"), INDICATOR, "left")
        .groupBy(INDICATOR)
        .agg(
            F.count("*").alias("n_places"),
            F.regr_slope(y, x).alias("beta"),
            F.regr_sxx(y, x).alias("_sxx"),
            F.regr_syy(y, x).alias("_syy"),
            F.regr_r2(y, x).alias("_r2"),
            F.coalesce(F.avg(near.cast("double")), F.lit(0.0)).alias("ceiling_share"),
        )
        .where(F.col("n_places") >= MIN_PLACES)
    )
    left_over = F.greatest(F.col("_syy") - F.col("beta") * F.col("beta") * F.col("_sxx"), F.lit(0.0))
    error = F.sqrt(left_over / (F.col("n_places") - 2) / F.nullif(F.col("_sxx"), F.lit(0.0)))
    half = t_975_column(F.col("n_places") - 2) * error
    out = fit.select(
        INDICATOR,
        "n_places",
        "beta",
        (F.col("beta") - half).alias("beta_ci_low"),
        (F.col("beta") + half).alias("beta_ci_high"),
        F.when(F.col("_syy") > 0, F.col("_r2")).otherwise(F.lit(0.0)).alias("r_squared"),
        "ceiling_share",
    )
    if all_places is None:
        return out
    reporting = (
        all_places.select(*SERIES)
        .distinct()
        .groupBy(INDICATOR)
        .agg(F.count("*").alias("total_places"))
    )
    share = F.col("n_places") / F.col("total_places")
    return (
        out.join(reporting, INDICATOR)
        .withColumn("coverage_share", share)
        .withColumn("low_coverage", share < LOW_COVERAGE)
    )


def convergence_movers(
    places: DataFrame, indicators: DataFrame, top_n: int = 5
) -> tuple[DataFrame, DataFrame]:
    """(movers, pools): the laggards that improved most and least per indicator.

    A laggard is on the bad side of the median base value, inclusive. The two lists may
    overlap. ``pools`` has the median and the number of laggards. Neutral indicators have none.
    """
    polar = indicators.where(
        F.col("polarity").isin("higher_is_better", "lower_is_better")
    ).select(INDICATOR, "polarity")
    higher = F.col("polarity") == "higher_is_better"
    rows = places.join(polar, INDICATOR).withColumn(
        "improvement", F.when(higher, F.col("change")).otherwise(-F.col("change"))
    )
    middle = exact_quantiles(rows, [INDICATOR], "base_value", {"behind_threshold": 0.5})
    behind = join_keys(rows, middle, [INDICATOR]).where(
        F.when(higher, F.col("base_value") <= F.col("behind_threshold")).otherwise(
            F.col("base_value") >= F.col("behind_threshold")
        )
    )
    pools = behind.groupBy(INDICATOR).agg(
        F.count("*").alias("n_behind"), F.first("behind_threshold").alias("behind_threshold")
    )
    tie = F.asc("place_id")
    lists = [
        top_per_key(behind, [INDICATOR], [F.desc("improvement"), tie], top_n, "position")
        .withColumn("list", F.lit("catching_up")),
        top_per_key(behind, [INDICATOR], [F.asc("improvement"), tie], top_n, "position")
        .withColumn("list", F.lit("falling_behind")),
    ]
    columns = [INDICATOR, "list", "position", "place_id"]
    columns += ["base_value", "end_value", "change", "improvement"]
    return lists[0].unionByName(lists[1]).select(*columns), pools
