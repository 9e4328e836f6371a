"""Change, anomaly, trend, progress and convergence cases."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelwright.operators import anomaly, change, convergence, trend

NOISY = {
    f"P{i:02d}": [50 + ((i * 7 + t * 13) % 11) / 10 * (1 if (i + t) % 2 else -1) for t in range(12)]
    for i in range(14)
}


def yoy(df):
    return change.change_from_previous(df)


def test_change_uses_the_previous_observed_period(panel):
    rows = yoy(panel({"A": {2000: 10, 2001: 12, 2003: 20}})).orderBy("period").collect()
    assert [(r.date, r.prior_date, r.change, r.gap_years) for r in rows] == [
        ("2001", "2000", 2.0, 1),
        ("2003", "2001", 8.0, 2),
    ]


def test_change_drops_missing_values_and_keeps_places_apart(panel):
    df = panel({"A": {2000: 1, 2001: None, 2002: 4}, "B": {2000: 5}, "C": {2000: math.nan, 2001: 2}})
    rows = yoy(df).collect()
    assert [(r.place_id, r.prior_date, r.change, r.gap_years) for r in rows] == [("A", "2000", 3.0, 2)]


def test_degenerate_panels_give_nothing(panel, indicators):
    for series in ({"A": [1.0]}, {"A": [1.0, 2.0]}, {"A": [None, None]}):
        found = anomaly.detect_anomalies(panel(series), indicators())
        assert found.count() == 0


def test_scales_need_two_changes_and_match_pandas(panel):
    assert change.change_scales(yoy(panel({"A": [1, 2]}))).count() == 0
    changes = yoy(panel(NOISY))
    c = changes.toPandas()["change"]
    scale = 1.4826 * (c - c.median()).abs().median()
    got = change.change_scales(changes).first()
    assert got.pooled_scale == pytest.approx(scale)
    assert got.magnitude_gate == pytest.approx(max(scale, c.abs().quantile(0.9)))
    assert got.n_changes == len(c)


def spikes(df, **options):
    changes = yoy(df)
    return anomaly.detect_spikes(changes, change.change_scales(changes), **options)


def test_spike_in_an_otherwise_quiet_place(panel):
    series = dict(NOISY, HOT=[50, 50.1, 50.3, 50.2, 50.4, 50.3, 80, 50.2, 50.3, 50.4, 50.2, 50.3])
    rows = spikes(panel(series)).collect()
    assert [r.place_id for r in rows] == ["HOT"]
    assert rows[0].date in ("2006", "2007") and rows[0].kind == "spike"
    assert rows[0].detail.startswith(("jumped up by 29.7", "dropped by 29.8"))


def test_flat_place_does_not_divide_by_zero(panel):
    series = dict(NOISY, FLAT=[50.0] * 12)
    assert "FLAT" not in [r.place_id for r in spikes(panel(series)).collect()]
    assert spikes(panel({"A": [5.0] * 9, "B": [6.0] * 9})).count() == 0


def test_step_from_a_flat_history_is_scaled_by_the_pool(panel):
    series = dict(NOISY, STEP=[50.0] * 6 + [90.0] * 6)
    rows = {r.place_id: r for r in spikes(panel(series)).collect()}
    assert math.isfinite(rows["STEP"].score) and rows["STEP"].change == 40.0


def test_tiny_wobble_of_a_still_place_stays_below_the_gate(panel):
    series = dict(NOISY, CALM=[50.0] * 6 + [50.05] + [50.0] * 5)
    assert "CALM" not in [r.place_id for r in spikes(panel(series)).collect()]


def test_spike_needs_enough_changes_and_is_limited(panel):
    series = dict(NOISY, SHORT=[50, 50.1, 90])
    assert "SHORT" not in [r.place_id for r in spikes(panel(series)).collect()]
    many = dict(NOISY, **{f"H{i}": [50.0] * 6 + [90.0 + i] * 6 for i in range(3)})
    assert spikes(panel(many), top_n=2).count() == 2


def test_peer_outlier(panel):
    series = {f"P{i:02d}": [50 + 0.1 * t + 0.01 * i * t for t in range(8)] for i in range(15)}
    series["ODD"] = [50, 50.1, 50.2, 65, 65.1, 65.2, 65.3, 65.4]
    changes = yoy(panel(series))
    scales = change.change_scales(changes)
    rows = anomaly.detect_peer_outliers(changes, scales).collect()
    assert [(r.place_id, r.date) for r in rows] == [("ODD", "2003")]
    assert rows[0].detail.startswith("gained 14.8 in 2003")
    assert anomaly.detect_peer_outliers(changes, scales, min_peers=17).count() == 0


def interpolated(df, **options):
    changes = yoy(df)
    return anomaly.detect_interpolated(changes, change.change_scales(changes), **options)


def test_straight_line_among_noisy_peers(panel):
    rng = np.random.default_rng(3)
    series = {f"P{i}": list(50 + np.cumsum(rng.normal(0, 1.0, 12))) for i in range(12)}
    series["A"] = [20 + 2.0 * t for t in range(7)] + [45, 44, 47]
    rows = interpolated(panel(series)).where(F.col("place_id") == "A").collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r.prior_date, r.date, r.score) == ("2000", "2006", 6.0)
    assert r.change == pytest.approx(12.0)
    assert r.detail.startswith("rose by almost exactly 2.00 every year from 2000 to 2006.")


@pytest.mark.parametrize(
    "values",
    [
        [100.0] * 10,
        {2000: 20, 2001: 22, 2002: 24, 2003: 40},
        {2000: 20, 2001: 22, 2003: 24, 2004: 26, 2006: 28},
    ],
    ids=["pinned", "short run", "gap inside"],
)
def test_not_interpolated(panel, values):
    rng = np.random.default_rng(5)
    series = {f"P{i}": list(50 + np.cumsum(rng.normal(0, 1.5, 12))) for i in range(12)}
    series["A"] = values
    assert "A" not in [r.place_id for r in interpolated(panel(series)).collect()]


def test_all_flat_has_no_scale_to_judge_by(panel):
    assert interpolated(panel({f"P{i}": [5.0] * 8 for i in range(4)})).count() == 0


def brute_runs(changes, pooled, tol, step, min_run):
    """Longest run per place, by walking each series."""
    best = {}
    for place, g in changes.groupby("place_id"):
        g = g.sort_values("period").reset_index(drop=True)
        start = 0
        for i in range(1, len(g) + 1):
            linked = i < len(g) and (
                g.gap_years[i] == 1 and g.gap_years[i - 1] == 1
                and abs(g.change[i]) >= step * pooled and abs(g.change[i - 1]) >= step * pooled
                and abs(g.change[i] - g.change[i - 1]) <= tol * pooled
            )
            if not linked:
                if i - start >= min_run and i - start > best.get(place, (0,))[0]:
                    best[place] = (i - start, g.prior_date[start], g.date[i - 1])
                start = i
    return best


def test_interpolated_runs_equal_a_walk_over_each_series(panel):
    rng = np.random.default_rng(11)
    series = {}
    for i in range(40):
        years = sorted(rng.choice(np.arange(1990, 2020), size=rng.integers(8, 28), replace=False))
        steps = rng.choice([0.0, 1.0, 1.1, -1.0, 3.0], size=len(years), p=[0.1, 0.4, 0.3, 0.1, 0.1])
        series[f"P{i:02d}"] = dict(zip(years, np.cumsum(steps)))
    changes = yoy(panel(series))
    scales = change.change_scales(changes)
    pooled = scales.first().pooled_scale
    assert pooled > 0
    got = anomaly.detect_interpolated(changes, scales, top_n=1000).collect()
    want = brute_runs(changes.toPandas(), pooled, 0.33, 1.0, 3)
    assert len(want) > 5
    assert {r.place_id: (int(r.score), r.prior_date, r.date) for r in got} == want


def trend_rows(spark, rows):
    return spark.createDataFrame(
        [("x", p, 25, s, lo, hi, 0.0, False) for p, s, lo, hi in rows],
        "indicator_key string, place_id string, n_obs int, slope double, slope_ci_low double, "
        "slope_ci_high double, intercept double, is_saturated boolean",
    )


def test_reversals_follow_polarity(spark, indicators):
    rows = [("DOWN", -1.0, -1.5, -0.5), ("MAYBE", -0.2, -0.9, 0.5), ("UP", 2.0, 1.0, 3.0), ("DEEP", -3.0, -4.0, -2.0)]
    t = trend_rows(spark, rows)
    found = anomaly.detect_reversals(t, indicators("higher_is_better")).collect()
    assert [r.place_id for r in sorted(found, key=lambda r: -r.score)] == ["DEEP", "DOWN"]
    assert found[0].date == "" and found[0].change is None
    assert any(r.detail.startswith("Moving down over its full reporting history (-3.00 per year)") for r in found)
    found = anomaly.detect_reversals(t, indicators("lower_is_better")).collect()
    assert [r.place_id for r in found] == ["UP"]
    assert anomaly.detect_reversals(t, indicators("neutral")).count() == 0
    assert anomaly.detect_reversals(t, indicators("higher_is_better"), top_n=1).count() == 1


def test_reversal_runs_without_scales(panel, spark, indicators):
    t = trend_rows(spark, [("DOWN", -1.0, -1.5, -0.5)])
    found = anomaly.detect_anomalies(panel({"A": [1.0]}), indicators(), t).collect()
    assert [r.kind for r in found] == ["reversal"]


def test_anomaly_summary_labels(spark, panel, indicators):
    changes = yoy(panel(dict(NOISY, HOT=[50.0] * 6 + [90.0] * 6)))
    found = anomaly.detect_spikes(changes, change.change_scales(changes))
    found = found.unionByName(found.withColumn("kind", F.lit("interpolated")))
    names = spark.createDataFrame([("HOT", ""), ("P01", "One")], "place_id string, place_name string")
    chart = spark.createDataFrame([("HOT",)], "place_id string")
    rows = anomaly.anomaly_summary(found, names, chart).collect()
    assert {r.type for r in rows} == {"Sudden jump/drop", "interpolated"}
    assert {(r.country, r.on_chart, r.change) for r in rows} == {("HOT", "Yes", "+40.0")}


# ---- trends ----


def hac_by_matrices(x, y, lags=2):
    X = np.column_stack([np.ones_like(x), x])
    beta, *_ = np.linalg.lstsq(X, y, rcond=None)
    u = y - X @ beta
    g = X * u[:, None]
    S = g.T @ g
    for l in range(1, lags + 1):
        G = g[l:].T @ g[:-l]
        S += (1 - l / (lags + 1)) * (G + G.T)
    bread = np.linalg.inv(X.T @ X)
    return beta[1], beta[0], math.sqrt((bread @ S @ bread)[1, 1])


def test_trend_intervals_equal_the_matrix_form(panel):
    rng = np.random.default_rng(1)
    series = {}
    for i in range(12):
        years = sorted(rng.choice(np.arange(1, 40), size=rng.integers(4, 30), replace=False))
        series[f"P{i}"] = dict(zip(years, np.cumsum(rng.normal(size=len(years)))))
    for r in trend.fit_trends(panel(series)).collect():
        x = np.array(list(series[r.place_id]), dtype=float)
        y = np.array(list(series[r.place_id].values()))
        slope, intercept, error = hac_by_matrices(x, y)
        assert r.n_obs == len(x)
        assert r.slope == pytest.approx(slope, abs=1e-9)
        assert r.intercept == pytest.approx(intercept, abs=1e-7)
        assert r.slope_ci_low == pytest.approx(slope - 1.959963985 * error, abs=1e-6)
        assert r.slope_ci_high == pytest.approx(slope + 1.959963985 * error, abs=1e-6)


def test_trend_of_a_line_and_of_too_few_points(panel):
    df = panel({"A": [10 + 2.0 * t for t in range(25)], "B": [1, 2], "C": [1, None, 2]})
    rows = trend.fit_trends(df).collect()
    assert [r.place_id for r in rows] == ["A"]
    assert rows[0].slope == pytest.approx(2.0, abs=0.01) and rows[0].n_obs == 25
    assert rows[0].slope_ci_low <= rows[0].slope <= rows[0].slope_ci_high


def test_saturated_places_are_listed_not_fitted(panel, indicators):
    df = panel({"FULL": [90, 95, 99.6], "REST": [50, 55, 61], "GONE": [90, 99.9, None]})
    fitted, full = trend.fit_trends_excluding_saturated(df, indicators(ceiling=100.0))
    assert [r.place_id for r in full.collect()] == ["FULL"]
    assert [r.place_id for r in fitted.collect()] == ["REST"]
    fitted, full = trend.fit_trends_excluding_saturated(df, indicators())
    assert full.count() == 0
    assert {r.place_id for r in fitted.collect()} == {"FULL", "REST"}


@pytest.mark.parametrize(
    "latest, year, slope, target, want",
    [
        (80.0, 2020, 2.0, 100.0, 10.0),
        (80.0, 2020, 0.0, 100.0, math.inf),
        (80.0, 2020, -1.0, 100.0, math.inf),
        (50.0, 2020, 0.1, 100.0, math.inf),
        (100.0, 2020, 1.0, 100.0, 0.0),
        (120.0, 2020, 1.0, 100.0, 0.0),
    ],
)
def test_periods_to_target(spark, latest, year, slope, target, want):
    got = spark.range(1).select(
        trend.periods_to_target(F.lit(latest), F.lit(year), F.lit(slope), F.lit(target)).alias("n")
    ).first().n
    assert got == want


def one_progress(df, meta):
    return trend.progress(df, meta).collect()


def test_progress_forward_and_backward(panel, indicators):
    (r,) = one_progress(panel({"A": [60 + 2 * t for t in range(11)]}), indicators(target=100.0, year=2030))
    assert r.latest_value == 80 and r.latest_year == 2010 and r.gap == 20
    assert r.projected_year == pytest.approx(2020) and r.on_track
    (r,) = one_progress(panel({"A": [10 - 0.5 * t for t in range(11)]}), indicators("lower_is_better", target=4.0, year=2011))
    assert r.gap == pytest.approx(1.0) and r.slope == pytest.approx(-0.5)
    assert r.projected_year == pytest.approx(2012) and not r.on_track


def test_progress_prefers_history_over_pace(panel, indicators):
    series = [70 + 3 * t for t in range(11)] + [99, 98]
    (r,) = one_progress(panel({"A": series}), indicators(target=100.0, year=2030))
    assert r.projected_year == 2010 and r.on_track and r.gap == 2


def test_progress_without_target_or_history(panel, indicators):
    (r,) = one_progress(panel({"A": [1, 2, 3]}), indicators())
    assert (r.gap, r.projected_year, r.on_track) == (None, None, None) and r.slope == pytest.approx(1)
    (r,) = one_progress(panel({"A": [1, 2], "B": [None, None]}), indicators(target=9.0, year=2030))
    assert r.slope is None and r.projected_year is None and r.on_track is None and r.gap == 7
    (r,) = one_progress(panel({"A": [3, 2, 1]}), indicators(target=9.0, year=2030))
    assert r.projected_year == math.inf and not r.on_track


def test_progress_table_texts(spark, panel, indicators):
    df = panel({"A": [60 + 2 * t for t in range(11)], "B": [100, 101, 102], "C": [3, 2, 1], "D": [1, 2]})
    names = spark.createDataFrame([("A", "Aland")], "place_id string, place_name string")
    rows = {r.place_id: r for r in trend.progress_table(trend.progress(df, indicators(target=100.0, year=2015)), names).collect()}
    assert (rows["A"].country, rows["A"].gap_to_target, rows["A"].reaches_target, rows["A"].on_track) == ("Aland", "20.0 remaining", "2020", "❌ No")
    assert (rows["B"].country, rows["B"].gap_to_target, rows["B"].on_track) == ("B", "Met", "✅ Yes")
    assert rows["C"].reaches_target == "Not at current pace"
    assert (rows["D"].reaches_target, rows["D"].on_track) == ("—", "—")
    plain = trend.progress_table(trend.progress(df, indicators()), names).first()
    assert plain.gap_to_target is None and plain.on_track is None


# ---- convergence ----


def ends(df, **endpoints):
    return convergence.endpoint_values(df, convergence.series_endpoints(df))


def test_convergence_signal(panel, indicators):
    start = [10, 20, 30, 40, 50, 60, 70, 80]
    places, _ = ends(panel({f"P{i}": {2000: v, 2020: 100} for i, v in enumerate(start)}))
    r = convergence.convergence(places, indicators(ceiling=100.0)).first()
    assert r.n_places == 8 and r.beta == pytest.approx(-1.0) and r.r_squared > 0.9
    assert r.beta_ci_low <= r.beta <= r.beta_ci_high
    assert r.ceiling_share == 1.0


def test_convergence_interval_by_hand(panel, indicators):
    x = np.array([10.0, 25, 31, 44, 58, 63])
    y = np.array([12.0, 20, 45, 40, 60, 80])
    places, _ = ends(panel({f"P{i}": {2000: a, 2010: b} for i, (a, b) in enumerate(zip(x, y))}))
    r = convergence.convergence(places, indicators()).first()
    d = y - x
    sxx = ((x - x.mean()) ** 2).sum()
    beta = ((x - x.mean()) * d).sum() / sxx
    rss = ((d - d.mean() - beta * (x - x.mean())) ** 2).sum()
    half = 2.7764451052 * math.sqrt(rss / 4 / sxx)
    assert r.beta == pytest.approx(beta)
    assert r.beta_ci_high - r.beta == pytest.approx(half, rel=1e-8)
    assert r.r_squared == pytest.approx(1 - rss / ((d - d.mean()) ** 2).sum())


def test_convergence_ceiling_share_and_limits(panel, indicators):
    five = {"A": (50, 100), "B": (60, 99.6), "C": (99.8, 99), "D": (20, 30), "E": (10, 15)}
    df = panel({p: {2000: a, 2010: b} for p, (a, b) in five.items()})
    places, _ = ends(df)
    assert convergence.convergence(places, indicators(ceiling=100.0)).first().ceiling_share == pytest.approx(0.6)
    four, _ = ends(df.where("place_id <> 'E'"))
    assert convergence.convergence(four, indicators()).count() == 0
    same = panel({f"P{i}": {2000: i, 2010: i + 5} for i in range(6)})
    assert convergence.convergence(ends(same)[0], indicators()).first().r_squared == 0.0


def test_convergence_reports_incomplete_places_and_coverage(panel, indicators):
    series = {f"P{i}": {2000: i, 2010: i * 2} for i in range(6)}
    series["GAP"] = {2000: None, 2010: 5}
    series["LATE"] = {2005: 1, 2010: 3}
    df = panel(series)
    places, lacking = ends(df)
    assert [r.place_id for r in lacking.collect()] == ["GAP"]
    r = convergence.convergence(places, indicators(), all_places=df).first()
    assert (r.n_places, r.total_places, r.low_coverage) == (6, 8, True)


def test_movers_follow_polarity(panel, indicators):
    series = {"A": (10, 30), "B": (20, 21), "C": (30, 60), "D": (40, 20), "E": (50, 55), "F": (60, 61), "G": (70, 71)}
    places, _ = ends(panel({p: {2000: a, 2010: b} for p, (a, b) in series.items()}))
    movers, pools = convergence.convergence_movers(places, indicators("higher_is_better"), top_n=2)
    lists = {}
    for r in movers.orderBy("position").collect():
        lists.setdefault(r.list, []).append(r.place_id)
    assert lists == {"catching_up": ["C", "A"], "falling_behind": ["D", "B"]}
    pool = pools.first()
    assert (pool.n_behind, pool.behind_threshold) == (4, 40.0)
    movers, _ = convergence.convergence_movers(places, indicators("lower_is_better"), top_n=1)
    got = {r.list: (r.place_id, r.improvement) for r in movers.collect()}
    assert got == {"catching_up": ("D", 20.0), "falling_behind": ("E", -5.0)}
    movers, pools = convergence.convergence_movers(places, indicators("neutral"))
    assert movers.count() == 0 and pools.count() == 0


def test_row_order_partitioning_and_other_indicators_do_not_matter(panel, indicators):
    df = panel(dict(NOISY, HOT=[50.0] * 6 + [90.0] * 6))
    other = panel({f"Q{i}": [i * t % 5 for t in range(9)] for i in range(12)}, indicator="y")
    key = lambda d: sorted(map(str, anomaly.detect_anomalies(d, indicators()).where("indicator_key = 'x'").collect()))
    base = key(df)
    assert base and key(df.orderBy(F.rand(3)).repartition(7)) == base
    assert key(df.unionByName(other)) == base


def test_progress_does_not_hang_on_the_order_of_the_sums_behind_a_slope(spark, indicators):
    rows = [("x", f"p{n}", 1972 + i, 197.05 + 2.3090625 * (i - 29) + n / 100) for n in range(40) for i in range(n % 2, 30, 1 + n % 3)]
    schema = "indicator_key string, place_id string, period int, value double"
    panel = spark.createDataFrame(rows[1::2] + rows[::-2], schema)
    found = trend.progress(panel, indicators(target=1000.0, year=2005)).collect()
    assert len(found) == 40 and {r.slope for r in found} == {2.3090625}


def test_a_projection_onto_the_target_year_is_on_track(spark, indicators):
    series = [30.0, 100 / 3, 110 / 3, 40.0]
    rows = [("x", f"p{n}", 1990 + n + i, v) for n in range(12) for i, v in enumerate(series)]
    schema = "indicator_key string, place_id string, period int, value double"
    found = trend.progress(spark.createDataFrame(rows, schema), indicators(target=50.0, year=2002)).collect()
    assert {r.place_id for r in found if r.projected_year <= 2002} == {r.place_id for r in found if r.on_track}
    assert {r.projected_period - r.latest_period for r in found} == {3.0}
