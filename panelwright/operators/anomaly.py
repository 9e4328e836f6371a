"""Four detectors of unusual movement, each over all indicators and places of a panel.

Every detector gives rows of one shape (``ANOMALY_COLUMNS``), at most ``top_n`` per indicator
and one per place. Equal scores are ordered by place, then by period.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions.order_stats import join_keys, top_per_key
from panelwright.functions.text import fixed, signed
from panelwright.operators.change import (
    change_from_previous,
    change_scales,
    robust_scale,
    with_own_scale,
)
from panelwright.schema import (
    INDICATOR,
    INTERPOLATED_DETAIL,
    KIND_LABELS,
    PEER_DETAIL,
    REVERSAL_DETAIL,
    SERIES,
    SPIKE_DETAIL,
)
from panelwright.staging import settle

ANOMALY_COLUMNS = [
    "indicator_key",
    "place_id",
    "kind",
    "date",
    "value",
    "prior_value",
    "prior_date",
    "change",
    "score",
    "detail",
]


def _flag_departures(changes: DataFrame, scales: DataFrame, k: float, top_n: int) -> DataFrame:
    """Keep changes far from ``_centre``; the worst per place, then the worst per indicator."""
    floor = F.nullif(F.greatest("_scale", "pooled_scale"), F.lit(0.0))
    score = F.coalesce(F.abs(F.col("change") - F.col("_centre")) / floor, F.lit(0.0))
    flagged = (
        join_keys(changes, scales, [INDICATOR])
        .withColumn("score", score)
        .where((F.col("score") > k) & (F.abs("change") >= F.col("magnitude_gate")))
    )
    row = F.struct("period", "date", "value", "prior_value", "prior_date", "change", "score")
    worst = (
        flagged.groupBy(*SERIES)
        .agg(F.max_by(row, F.struct("score", -F.col("period"))).alias("_row"))
        .select(*SERIES, "_row.*")
    )
    return top_per_key(worst, [INDICATOR], [F.desc("score"), F.asc("place_id")], top_n)


def _anomalies(df: DataFrame, kind: str, detail: Column) -> DataFrame:
    return df.withColumn("kind", F.lit(kind)).withColumn("detail", detail).select(*ANOMALY_COLUMNS)


def detect_spikes(
    changes: DataFrame, scales: DataFrame, k: float = 3.5, min_obs: int = 6, top_n: int = 8
) -> DataFrame:
    """Changes unusual for the place itself, against its own typical change."""
    if "own_scale" not in changes.columns:
        changes = with_own_scale(changes)
    own = changes.where(F.col("own_count") >= min_obs).withColumnsRenamed(
        {"own_centre": "_centre", "own_scale": "_scale"}
    )
    found = _flag_departures(own, scales, k, top_n)
    way = F.when(F.col("change") > 0, "jumped up").otherwise("dropped")
    return _anomalies(
        found, "spike", F.format_string(SPIKE_DETAIL, way, fixed(F.abs("change"), 1), "prior_date", "date")
    )


def detect_peer_outliers(
    changes: DataFrame,
    scales: DataFrame,
    k: float = 3.5,
    min_peers: int = 10,
    top_n: int = 8,
) -> DataFrame:
    """Changes unusual against all places reporting the same period."""
    peers = [INDICATOR, "period"]
    typical = robust_scale(changes, peers, "change").where(F.col("n_values") >= min_peers)
    # One row per (indicator, period) that is read against every change: written first, so
    # whether it is small enough to broadcast is known.
    typical = settle(
        typical.select(*peers, F.col("median").alias("_centre"), F.col("scale").alias("_scale"))
    )
    found = _flag_departures(join_keys(changes, typical, peers), scales, k, top_n)
    way = F.when(F.col("change") > 0, "gained").otherwise("lost")
    return _anomalies(
        found, "peer_outlier", F.format_string(PEER_DETAIL, way, fixed(F.abs("change"), 1), "date")
    )


def detect_interpolated(
    changes: DataFrame,
    scales: DataFrame,
    min_run: int = 3,
    tol_frac: float = 0.33,
    min_step_frac: float = 1.0,
    top_n: int = 8,
) -> DataFrame:
    """Runs of near-equal steps between neighbouring periods: values likely filled in.

    A change that does not continue the step before it starts a new run, so a run is an island
    of rows and its size is the number of changes it covers.
    """
    series = Window.partitionBy(*SERIES).orderBy("period")
    sofar = series.rowsBetween(Window.unboundedPreceding, 0)
    before, gap_before = F.lag("change").over(series), F.lag("gap_years").over(series)
    step = F.col("pooled_scale") * min_step_frac
    rows = (
        join_keys(changes, scales.where(F.col("pooled_scale") > 0), [INDICATOR])
        .withColumn("_before", before)
        .withColumn("_gap_before", gap_before)
    )
    continues = F.coalesce(
        (F.col("gap_years") == 1)
        & (F.col("_gap_before") == 1)
        & (F.abs("change") >= step)
        & (F.abs("_before") >= step)
        & (F.abs(F.col("change") - F.col("_before")) <= F.col("pooled_scale") * tol_frac),
        F.lit(False),
    )
    runs = (
        rows.withColumn("_new", (~continues).cast("int"))
        .withColumn("_run", F.sum("_new").over(sofar))
        .groupBy(*SERIES, "_run")
        .agg(
            F.count("*").alias("_n"),
            F.min("period").alias("_start"),
            F.max_by(F.struct("date", "value"), "period").alias("_last"),
            F.min_by(F.struct("prior_date", "prior_value"), "period").alias("_first"),
            F.avg("change").alias("_step"),
        )
        .where(F.col("_n") >= max(min_run, 2))
    )
    longest = (
        runs.groupBy(*SERIES)
        .agg(
            F.max_by(
                F.struct("_n", "_last", "_first", "_step"), F.struct("_n", -F.col("_start"))
            ).alias("_r")
        )
        .select(
            *SERIES,
            F.col("_r._last.date").alias("date"),
            F.col("_r._last.value").alias("value"),
            F.col("_r._first.prior_value").alias("prior_value"),
            F.col("_r._first.prior_date").alias("prior_date"),
            (F.col("_r._last.value") - F.col("_r._first.prior_value")).alias("change"),
            F.col("_r._n").cast("double").alias("score"),
            F.col("_r._step").alias("_step"),
        )
    )
    found = top_per_key(longest, [INDICATOR], [F.desc("score"), F.asc("place_id")], top_n)
    way = F.when(F.col("_step") > 0, "rose").otherwise("fell")
    return _anomalies(
        found,
        "interpolated",
        F.format_string(INTERPOLATED_DETAIL, way, fixed(F.abs("_step"), 2), "prior_date", "date"),
    )


def detect_reversals(trends: DataFrame, indicators: DataFrame, top_n: int = 8) -> DataFrame:
    """Fitted trends that run against the indicator's polarity with an interval clear of zero.

    ``indicators`` gives ``polarity`` per indicator_key; a neutral one has no wrong way.
    """
    up, down = F.col("polarity") == "lower_is_better", F.col("polarity") == "higher_is_better"
    wrong = (down & (F.col("slope") < 0) & (F.col("slope_ci_high") < 0)) | (
        up & (F.col("slope") > 0) & (F.col("slope_ci_low") > 0)
    )
    flagged = (
        trends.join(indicators.select(INDICATOR, "polarity"), INDICATOR)
        .where(wrong)
        .withColumn("score", F.abs("slope"))
    )
    found = top_per_key(flagged, [INDICATOR], [F.desc("score"), F.asc("place_id")], top_n)
    nothing = {c: F.lit(None).cast("double") for c in ("value", "prior_value", "change")}
    found = found.withColumns(
        {**nothing, "date": F.lit(""), "prior_date": F.lit(None).cast("string")}
    )
    way = F.when(down, "down").otherwise("up")
    return _anomalies(found, "reversal", F.format_string(REVERSAL_DETAIL, way, signed("slope", 2)))


def detect_anomalies(
    panel: DataFrame,
    indicators: DataFrame,
    trends: DataFrame | None = None,
    k: float = 3.5,
    min_obs: int = 6,
    min_peers: int = 10,
    top_n: int = 8,
) -> DataFrame:
    """All four detectors. The changes are written once and read by three of them."""
    changes = settle(with_own_scale(change_from_previous(panel)))
    scales = change_scales(changes)
    found = (
        detect_spikes(changes, scales, k, min_obs, top_n)
        .unionByName(detect_peer_outliers(changes, scales, k, min_peers, top_n))
        .unionByName(detect_interpolated(changes, scales, top_n=top_n))
    )
    if trends is not None:
        found = found.unionByName(detect_reversals(trends, indicators, top_n))
    return found


def anomaly_summary(anomalies: DataFrame, names: DataFrame, on_chart: DataFrame) -> DataFrame:
    """Readable rows: name (or id), kind label, and whether the place is on the chart."""
    label = F.col("kind")
    for kind, text in KIND_LABELS.items():
        label = F.when(F.col("kind") == kind, F.lit(text)).otherwise(label)
    shown = on_chart.select("place_id").distinct().withColumn("_shown", F.lit(True))
    named = names.where(F.col("place_name") != "").select("place_id", "place_name")
    return (
        anomalies.join(named, "place_id", "left")
        .join(shown, "place_id", "left")
        .select(
            INDICATOR,
            "place_id",
            F.coalesce("place_name", "place_id").alias("country"),
            label.alias("type"),
            F.when(F.col("date") == "", "—").otherwise(F.col("date")).alias("year"),
            F.when(F.col("change").isNull(), "—")
            .otherwise(signed("change", 1))
            .alias("change"),
            F.col("detail").alias("why"),
            F.when(F.col("_shown"), "Yes").otherwise("Add it above ↑").alias("on_chart"),
        )
    )
