"""Weighted medians, reference lines, quantile bins, modal dates and wide tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.functions.order_stats import (
    WEIGHT,
    exact_quantiles,
    join_keys,
    sums_before,
    top_per_key,
    value_cells,
)
from panelwright.functions.text import fixed
from panelwright.operators.change import known
from panelwright.schema import INDICATOR
from panelwright.staging import settle


def weighted_median(
    df: DataFrame, keys: Sequence[str], value: str, weight: str, out: str
) -> DataFrame:
    """Smallest value whose cumulative weight reaches half of the key's total weight.

    Weights are summed as decimals, so a sum that stands on the half does so in any order. A row
    without a value or a weight does not count.
    """
    keys = list(keys)
    weighed = df.where(known(weight)).withColumn("_weight", F.col(weight).cast(WEIGHT))
    cells = value_cells(weighed, keys, value, F.col("_weight"))

    def reaches(before: Column, n: Column, total: Column) -> Column:
        return 2 * (before + n) >= total

    found = sums_before(cells, keys, reaches)
    reached = reaches(F.col("_before"), F.col("_n"), F.col("_all"))
    return found.where(reached).groupBy(*keys).agg(F.min("_v").alias(out))


def reference_lines(
    points: DataFrame, keys: Sequence[str], x: str, y: str, weight: str
) -> DataFrame:
    """x_ref and y_ref per key: weighted medians, or plain ones where the weights sum to zero."""
    keys = list(keys)
    lines = points.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(known(weight), F.col(weight))), F.lit(0.0)).alias("_w")
    )
    for column, name in ((x, "x"), (y, "y")):
        heavy = weighted_median(points, keys, column, weight, f"_{name}_heavy")
        plain = exact_quantiles(points, keys, column, {f"_{name}_plain": 0.5})
        lines = join_keys(join_keys(lines, heavy, keys, "left"), plain, keys, "left")
    lines = lines.select(
        *keys,
        F.when(F.col("_w") > 0, F.col("_x_heavy")).otherwise(F.col("_x_plain")).alias("x_ref"),
        F.when(F.col("_w") > 0, F.col("_y_heavy")).otherwise(F.col("_y_plain")).alias("y_ref"),
    )
    return settle(lines)


def with_quadrants(
    points: DataFrame, lines: DataFrame, keys: Sequence[str], x: str, y: str
) -> DataFrame:
    """Names each point's quadrant; ``headroom`` is low on both axes."""
    low_x, low_y = F.col(x) < F.col("x_ref"), F.col(y) < F.col("y_ref")
    quadrant = (
        F.when(low_x & low_y, "headroom")
        .when(low_x, "low_x_high_y")
        .when(low_y, "high_x_low_y")
        .otherwise("high_both")
    )
    return join_keys(points, lines, list(keys)).withColumn("quadrant", quadrant)


def quantile_breaks(df: DataFrame, keys: Sequence[str], value: str, n_bins: int = 5) -> DataFrame:
    """Bin edges at the quantiles of a key's distinct values, repeated edges removed.

    With no more distinct values than bins the edges are the values; a single value is both
    edges of its one bin.
    """
    keys = list(keys)
    distinct = value_cells(df, keys, value).select(*keys, "_v")
    counts = distinct.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"))
    names = {f"_q{i}": i / n_bins for i in range(n_bins + 1)}
    edges = exact_quantiles(distinct, keys, "_v", names)
    few = (
        top_per_key(distinct, keys, [F.asc("_v")], n_bins)
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list("_v")).alias("_few"))
    )
    breaks = (
        F.when(F.col("_n") <= 1, F.array("_lo", "_lo"))
        .when(F.col("_n") <= n_bins, F.col("_few"))
        .otherwise(F.array_distinct(F.array(*names)))
    )
    joined = join_keys(join_keys(counts, edges, keys), few, keys)
    return settle(joined.select(*keys, F.col("_n").alias("n_distinct"), breaks.alias("breaks")))


def bin_index(value: Column, breaks: Column) -> Column:
    """First bin whose upper edge is at or above the value; values beyond the end use the last."""
    below = F.size(F.filter(breaks, lambda b: b < value))
    index = F.greatest(F.lit(0), F.least(F.size(breaks) - 2, below - 1))
    return F.when(value.isNotNull() & (F.size(breaks) >= 2), index)


def bin_label(breaks: Column, index: Column, unit: Column | None = None) -> Column:
    low = F.try_element_at(breaks, (index + 1).cast("int"))
    high = F.try_element_at(breaks, (index + 2).cast("int"))
    suffix = F.lit("") if unit is None else F.coalesce(F.concat(F.lit(" "), unit), F.lit(""))
    text = F.concat(
        fixed(low, 1),
        suffix,
        F.lit(" – "),
        fixed(high, 1),
        suffix,
    )
    return F.when(index.isNotNull(), text)


def shade_geometry(geometry: DataFrame, values: DataFrame, breaks: DataFrame) -> DataFrame:
    """Every geometry with its value and bin; one without a value is an explicit ``no_data``.

    ``values`` holds one indicator's (place_id, value), ``breaks`` its single row of edges.
    """
    edges = breaks.select("breaks").scalar()
    rows = geometry.join(values.select("place_id", "value"), "place_id", "left")
    rows = rows.withColumn("breaks", edges)
    index = bin_index(F.col("value"), F.col("breaks"))
    return rows.withColumn("bin", index).withColumn(
        "bin_label", F.coalesce(bin_label(F.col("breaks"), F.col("bin")), F.lit("no_data"))
    ).drop("breaks")


def shade_indicators(geometry: DataFrame, values: DataFrame, breaks: DataFrame) -> DataFrame:
    """Every place of ``geometry`` under every indicator of ``breaks``, with its value and bin.

    One pass for all indicators of (indicator_key, place_id, value) and (indicator_key, breaks); the
    shapes stay in their table, which a place joins by its id. A place without a value is an
    explicit ``no_data``; repeated places count once, and values of other indicators are left out.
    """
    keys = breaks.agg(F.array_sort(F.collect_set(INDICATOR))).scalar()
    cells = geometry.select("place_id").distinct().select(F.explode(keys).alias(INDICATOR), "place_id")
    rows = cells.join(values.select(INDICATOR, "place_id", "value"), [INDICATOR, "place_id"], "left")
    rows = rows.join(breaks.select(INDICATOR, "breaks"), INDICATOR)
    rows = rows.withColumn("bin", bin_index(F.col("value"), F.col("breaks")))
    label = F.coalesce(bin_label(F.col("breaks"), F.col("bin")), F.lit("no_data"))
    return rows.select(INDICATOR, "place_id", "value", "bin", label.alias("bin_label"))


def modal_date(panel: DataFrame, keys: Sequence[str] = (INDICATOR,)) -> DataFrame:
    """Most frequent date per key, the earliest on a tie."""
    counts = panel.where(F.col("date").isNotNull()).groupBy(*keys, "date").agg(
        F.count("*").alias("_n")
    )
    return counts.groupBy(*keys).agg(
        F.min_by("date", F.struct(-F.col("_n"), F.col("date"))).alias("modal_date")
    )


def to_wide(
    panel: DataFrame,
    index: Sequence[str],
    indicator_keys: Sequence[str],
    value: str = "value",
    ordering: str = "period",
) -> DataFrame:
    """One column per listed indicator; the first known value of a cell by ``ordering``.

    The keys are given, so this is one conditional aggregation with a single shuffle on the index.
    """
    first = [
        F.min_by(value, F.when(known(value) & (F.col(INDICATOR) == k), F.col(ordering))).alias(k)
        for k in indicator_keys
    ]
    wide = panel.where(F.col(INDICATOR).isin(list(indicator_keys)))
    return wide.groupBy(*index).agg(*first)
