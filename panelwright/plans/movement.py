"""Queries on change, anomalies, trends, progress and convergence."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwright.functions import steps
from panelwright.functions.student_t import TABLE_UP_TO, expansion_terms, t_975
from panelwright.operators import anomaly, change, convergence, priority, trend
from panelwright.plans import panels
from panelwright.plans.registry import query, rounded, whole, with_tables
from panelwright.schema import INDICATOR, NORMAL_975
from panelwright.staging import settle

# ---- SQL building blocks ----

CTE = {
    "yoy": """SELECT * FROM (SELECT indicator_key, place_id, period, date, value,
        lag(date) OVER s AS prior_date, lag(value) OVER s AS prior_value,
        value - lag(value) OVER s AS change, period - lag(period) OVER s AS gap_years
        FROM user_day WINDOW s AS (PARTITION BY indicator_key, place_id ORDER BY period))
        WHERE prior_date IS NOT NULL""",
    "med": "SELECT indicator_key, median(change) AS m FROM yoy GROUP BY ALL",
    "scales": """SELECT y.indicator_key, 1.4826::DOUBLE * median(abs(change - m)) AS pooled_scale,
        greatest(1.4826::DOUBLE * median(abs(change - m)), quantile_cont(abs(change), 0.9)) AS magnitude_gate,
        count(*) AS n_changes FROM yoy y JOIN med USING (indicator_key)
        GROUP BY y.indicator_key HAVING count(*) >= 2""",
    "spike_z": """SELECT y.*, s.pooled_scale, s.magnitude_gate, coalesce(abs(change - m) /
        nullif(greatest(1.4826::DOUBLE * median(abs(change - m)) OVER (PARTITION BY indicator_key, place_id),
        pooled_scale), 0), 0) AS score
        FROM (SELECT *, median(change) OVER p AS m, count(*) OVER p AS n FROM yoy
              WINDOW p AS (PARTITION BY indicator_key, place_id)) y JOIN scales s USING (indicator_key)
        WHERE n >= 6""",
    "peer_m": "SELECT indicator_key, period, median(change) AS m, count(*) AS n FROM yoy GROUP BY ALL",
    "peer_s": """SELECT y.indicator_key, y.period, any_value(m) AS m, 1.4826::DOUBLE * median(abs(change - m)) AS sc
        FROM yoy y JOIN peer_m p ON y.indicator_key = p.indicator_key AND y.period = p.period
        WHERE n >= 10 GROUP BY ALL""",
    "peer_z": """SELECT y.*, coalesce(abs(change - m) / nullif(greatest(sc, pooled_scale), 0), 0) AS score,
        s.magnitude_gate FROM yoy y JOIN peer_s USING (indicator_key, period)
        JOIN scales s USING (indicator_key)""",
}
for _name, _source in (("spikes", "spike_z"), ("peers", "peer_z")):
    CTE[_name] = f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY indicator_key
        ORDER BY score DESC, place_id) AS pos FROM (SELECT *, row_number() OVER (
        PARTITION BY indicator_key, place_id ORDER BY score DESC, period) AS rn FROM {_source}
        WHERE score > 3.5 AND abs(change) >= magnitude_gate) WHERE rn = 1) WHERE pos <= 8"""


def _runs(step: str, tol: str) -> dict[str, str]:
    return {
        "links": f"""SELECT *, CASE WHEN gap_years = 1 AND pg = 1 AND abs(change) >= {step} * pooled_scale
            AND abs(pc) >= {step} * pooled_scale AND abs(change - pc) <= {tol} * pooled_scale
            THEN 0 ELSE 1 END AS fresh FROM (SELECT y.*, pooled_scale, lag(change) OVER w AS pc,
            lag(gap_years) OVER w AS pg FROM yoy y JOIN scales USING (indicator_key)
            WHERE pooled_scale > 0 WINDOW w AS (PARTITION BY indicator_key, place_id ORDER BY period))""",
        "runs": """SELECT indicator_key, place_id, count(*) AS n, min(period) AS st, max_by(date, period) AS date,
            max_by(value, period) AS value, min_by(prior_date, period) AS prior_date,
            min_by(prior_value, period) AS prior_value, avg(change) AS step
            FROM (SELECT *, sum(fresh) OVER (PARTITION BY indicator_key, place_id ORDER BY period) AS g FROM links)
            GROUP BY indicator_key, place_id, g HAVING count(*) >= 3""",
        "interp": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY indicator_key ORDER BY n DESC, place_id)
            AS pos FROM (SELECT *, row_number() OVER (PARTITION BY indicator_key, place_id ORDER BY n DESC, st)
            AS rn FROM runs) WHERE rn = 1) WHERE pos <= 8""",
    }


def _trend_tables(panel: str) -> dict[str, str]:
    return {
        "centred": f"""SELECT *, cx * (value - my - slope * cx) AS g FROM (SELECT *, period - mx AS cx FROM (
            SELECT indicator_key, place_id, period, value, avg(period) OVER s AS mx, avg(value) OVER s AS my,
            regr_slope(value, period) OVER s AS slope FROM {panel}
            WINDOW s AS (PARTITION BY indicator_key, place_id)))""",
        "trends": f"""SELECT indicator_key, place_id, count(*) AS n_obs, any_value(slope) AS slope,
            any_value(my - slope * mx) AS intercept, {NORMAL_975}::DOUBLE * sqrt(greatest(sum(g * g)
            + 4.0::DOUBLE / 3 * coalesce(sum(g * g1), 0) + 2.0::DOUBLE / 3 * coalesce(sum(g * g2), 0), 0)) / nullif(sum(cx * cx), 0)
            AS half FROM (SELECT *, lag(g, 1) OVER w AS g1, lag(g, 2) OVER w AS g2 FROM centred
            WINDOW w AS (PARTITION BY indicator_key, place_id ORDER BY period)) GROUP BY ALL HAVING count(*) >= 3""",
    }


ALL_PANELS = """SELECT indicator_key, place_id, period, date, value FROM cust_year UNION ALL
    SELECT indicator_key, place_id, period, date, value FROM supp_year UNION ALL
    SELECT indicator_key, place_id, period, date, value FROM nation_month"""
CTE["panel"] = ALL_PANELS
YOY = "user_day yoy med scales"


def _changes(spark, sf):
    return settle(change.change_from_previous(panels.user_day(spark, sf)))


def _panel(spark, sf):
    columns = ["indicator_key", "place_id", "period", "date", "value"]
    return (
        panels.cust_year(spark, sf).select(*columns)
        .unionByName(panels.supp_year(spark, sf).select(*columns))
        .unionByName(panels.nation_month(spark, sf).select(*columns))
    )


def _fitted(panel):
    """Trends with slopes that are equal up to the last bits made equal, as in the SQL."""
    return trend.fit_trends(panel).withColumn("slope", F.round("slope", 9))


def _show_anomalies(df):
    return df.select(
        "indicator_key", "place_id", "kind", "date", rounded("value", 4), rounded("prior_value", 4),
        "prior_date", rounded("change", 4), rounded("score"), "detail",
    )


def _anomaly_sql(kind: str, table: str, detail: str, score: str = "score", chg: str = "change") -> str:
    return f"""SELECT indicator_key, place_id, '{kind}' AS kind, date, round(value, 4) AS value,
        round(prior_value, 4) AS prior_value, prior_date, round({chg}, 4) AS change,
        round({score}, 6) AS score, {detail} AS detail FROM {table}"""


SPIKE_SQL = _anomaly_sql(
    "spike", "spikes",
    """CASE WHEN change > 0 THEN 'jumped up' ELSE 'dropped' END || ' by ' || printf('%.1f', abs(change))
    || ' between ' || prior_date || ' and ' || date
    || ', much more than this country''s usual year-to-year change.'""",
)
PEER_SQL = _anomaly_sql(
    "peer_outlier", "peers",
    """CASE WHEN change > 0 THEN 'gained ' ELSE 'lost ' END || printf('%.1f', abs(change)) || ' in ' || date
    || ', far more than other countries typically moved that same year.'""",
)
INTERP_SQL = _anomaly_sql(
    "interpolated", "interp",
    """CASE WHEN step > 0 THEN 'rose' ELSE 'fell' END || ' by almost exactly ' || printf('%.2f', abs(step))
    || ' every year from ' || prior_date || ' to ' || date || '. A series that moves in identical steps '
    || 'is usually filled in between two real measurements rather than measured each year.'""",
    "CAST(n AS DOUBLE)", "value - prior_value",
)
REVERSAL = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY indicator_key ORDER BY abs(slope) DESC, place_id)
    AS pos FROM (SELECT * REPLACE (round(slope, 9) AS slope) FROM trends) JOIN settings USING (indicator_key)
    WHERE (polarity = 'higher_is_better' AND slope < 0 AND slope + half < 0)
       OR (polarity = 'lower_is_better' AND slope > 0 AND slope - half > 0)) WHERE pos <= 8"""
REVERSAL_SQL = """SELECT indicator_key, place_id, 'reversal' AS kind, '' AS date, CAST(NULL AS DOUBLE) AS value,
    CAST(NULL AS DOUBLE) AS prior_value, CAST(NULL AS VARCHAR) AS prior_date, CAST(NULL AS DOUBLE) AS change,
    round(abs(slope), 6) AS score, 'Moving ' || CASE WHEN polarity = 'higher_is_better' THEN 'down' ELSE 'up' END
    || ' over its full reporting history (' || printf('%+.2f', slope)
    || ' per year), not just noise in a single year.' AS detail FROM reversals"""


# ---- change and anomalies ----


@query(
    "yoy_change",
    with_tables(
        "user_day yoy",
        """SELECT indicator_key, place_id, CAST(period AS BIGINT) AS period, date, value, prior_date, prior_value,
        round(change, 6) AS change, CAST(gap_years AS BIGINT) AS gap_years FROM yoy""",
        CTE,
    ),
)
def yoy_change(spark, sf):
    df = change.change_from_previous(panels.user_day(spark, sf))
    return df.withColumns({"change": rounded("change"), "period": whole("period")})


@query(
    "anomaly_scales",
    with_tables(
        YOY,
        """SELECT indicator_key, round(pooled_scale, 6) AS pooled_scale, round(magnitude_gate, 6) AS magnitude_gate,
        n_changes FROM scales""",
        CTE,
    ),
)
def anomaly_scales(spark, sf):
    df = change.change_scales(_changes(spark, sf))
    return df.select(INDICATOR, rounded("pooled_scale"), rounded("magnitude_gate"), "n_changes")


@query("spikes", with_tables(YOY + " spike_z spikes", SPIKE_SQL, CTE))
def spikes(spark, sf):
    changes = settle(
        change.with_own_scale(change.change_from_previous(panels.user_day(spark, sf)))
    )
    return _show_anomalies(anomaly.detect_spikes(changes, change.change_scales(changes)))


@query("peer_outliers", with_tables(YOY + " peer_m peer_s peer_z peers", PEER_SQL, CTE))
def peer_outliers(spark, sf):
    changes = _changes(spark, sf)
    scales = change.change_scales(changes)
    return _show_anomalies(anomaly.detect_peer_outliers(changes, scales))


@query(
    "interpolated_runs",
    with_tables(YOY + " links runs interp", INTERP_SQL, {**CTE, **_runs("0.2", "1.0")}),
)
def interpolated_runs(spark, sf):
    changes = _changes(spark, sf)
    scales = change.change_scales(changes)
    return _show_anomalies(
        anomaly.detect_interpolated(changes, scales, tol_frac=1.0, min_step_frac=0.2)
    )


@query(
    "reversals",
    with_tables(
        "cust_year supp_wide supp_year nation_month panel settings centred trends reversals",
        REVERSAL_SQL,
        {**CTE, **_trend_tables("panel"), "reversals": REVERSAL},
    ),
)
def reversals(spark, sf):
    trends = _fitted(_panel(spark, sf))
    return _show_anomalies(anomaly.detect_reversals(trends, panels.settings(spark)))


_ALL_ANOMALIES = (
    f"{SPIKE_SQL} UNION ALL {PEER_SQL} UNION ALL {INTERP_SQL} UNION ALL {REVERSAL_SQL}"
)
_ALL_TABLES = (
    YOY + " spike_z spikes peer_m peer_s peer_z peers links runs interp settings centred trends reversals"
)
_ALL_EXTRA = {
    **CTE, **_runs("1.0", "0.33"), **_trend_tables("user_day"), "reversals": REVERSAL,
}


@query("anomalies_all", with_tables(_ALL_TABLES, _ALL_ANOMALIES, _ALL_EXTRA))
def anomalies_all(spark, sf):
    panel = panels.user_day(spark, sf)
    trends = _fitted(panel)
    return _show_anomalies(anomaly.detect_anomalies(panel, panels.settings(spark), trends))


_FOCUS = """SELECT * FROM (SELECT l.*, row_number() OVER (PARTITION BY indicator_key ORDER BY
    CASE WHEN polarity = 'higher_is_better' THEN value ELSE -value END, place_id) AS position
    FROM lastday l JOIN settings USING (indicator_key)) WHERE position <= 5"""
_LAST = """SELECT indicator_key, place_id, max_by(value, period) AS value, max_by(date, period) AS date
    FROM user_day GROUP BY ALL"""


def _last(panel):
    return panel.groupBy("indicator_key", "place_id").agg(
        F.max_by("value", "period").alias("value"), F.max_by("date", "period").alias("date")
    )


@query(
    "anomaly_summary",
    with_tables(
        _ALL_TABLES + " user_names lastday focus found",
        """SELECT f.indicator_key, f.place_id, coalesce(nullif(place_name, ''), f.place_id) AS country,
        CASE kind WHEN 'spike' THEN 'Sudden jump/drop' WHEN 'peer_outlier' THEN 'Breaking from the pack'
        WHEN 'reversal' THEN 'Moving the wrong direction' ELSE kind END AS type,
        CASE WHEN f.date = '' THEN '—' ELSE f.date END AS year,
        CASE WHEN change IS NULL THEN '—' ELSE printf('%+.1f', change) END AS change, detail AS why,
        CASE WHEN f.place_id IN (SELECT place_id FROM focus) THEN 'Yes' ELSE 'Add it above ↑' END AS on_chart
        FROM found f LEFT JOIN user_names n ON f.place_id = n.place_id""",
        {**_ALL_EXTRA, "lastday": _LAST, "focus": _FOCUS, "found": _ALL_ANOMALIES},
    ),
)
def anomaly_summary(spark, sf):
    panel = panels.user_day(spark, sf)
    indicators = panels.settings(spark)
    found = anomaly.detect_anomalies(panel, indicators, _fitted(panel))
    found = found.withColumn("change", F.round("change", 4))
    focus = priority.default_focus(_last(panel), indicators)
    return anomaly.anomaly_summary(found, panels.user_names(spark, sf), focus)


@query(
    "default_focus",
    with_tables(
        "user_day settings lastday focus",
        "SELECT indicator_key, place_id, date, value, position FROM focus",
        {"lastday": _LAST, "focus": _FOCUS},
    ),
)
def default_focus(spark, sf):
    df = priority.default_focus(_last(panels.user_day(spark, sf)), panels.settings(spark))
    return df.select("indicator_key", "place_id", "date", "value", "position")


# ---- trends and progress ----

_TREND_TABLES = "cust_year supp_wide supp_year nation_month panel"
_TREND_COLUMNS = """indicator_key, place_id, n_obs, round(slope, 6) AS slope, round(slope - half, 6) AS slope_ci_low,
    round(slope + half, 6) AS slope_ci_high, round(intercept, 6) AS intercept"""


def _show_trends(df):
    return df.select(
        "indicator_key", "place_id", "n_obs", rounded("slope"), rounded("slope_ci_low"),
        rounded("slope_ci_high"), rounded("intercept"),
    )


@query(
    "trends",
    with_tables(
        _TREND_TABLES + " centred trends", f"SELECT {_TREND_COLUMNS} FROM trends",
        {**CTE, **_trend_tables("panel")},
    ),
)
def trends(spark, sf):
    return _show_trends(trend.fit_trends(_panel(spark, sf)))


_SATURATED = """SELECT indicator_key, place_id FROM (SELECT indicator_key, place_id, max_by(value, period) AS v
    FROM panel GROUP BY ALL) JOIN settings USING (indicator_key) WHERE v >= saturation_ceiling - 0.5"""
_UNSATURATED = "SELECT p.* FROM panel p ANTI JOIN saturated USING (indicator_key, place_id)"


@query(
    "trends_excluding_saturated",
    with_tables(
        _TREND_TABLES + " settings saturated rest centred trends",
        f"""SELECT {_TREND_COLUMNS}, false AS is_saturated FROM trends UNION ALL
        SELECT indicator_key, place_id, -1, 0, 0, 0, 0, true FROM saturated""",
        {**CTE, **_trend_tables("rest"), "saturated": _SATURATED, "rest": _UNSATURATED},
    ),
)
def trends_excluding_saturated(spark, sf):
    fitted, saturated = trend.fit_trends_excluding_saturated(
        _panel(spark, sf), panels.settings(spark)
    )
    zero = F.lit(0.0)
    listed = saturated.select(
        "indicator_key", "place_id", F.lit(-1).cast("bigint").alias("n_obs"), zero.alias("slope"),
        zero.alias("slope_ci_low"), zero.alias("slope_ci_high"), zero.alias("intercept"),
        F.lit(True).alias("is_saturated"),
    )
    return _show_trends(fitted).withColumn("is_saturated", F.lit(False)).unionByName(listed)


@query(
    "trend_fit_lines",
    with_tables(
        "supp_wide supp_year centred trends",
        """SELECT indicator_key, place_id, CAST(period AS BIGINT) AS period, round(value, 6) AS value,
        round(intercept + slope * period, 6) AS fitted
        FROM supp_year JOIN trends USING (indicator_key, place_id)""",
        _trend_tables("supp_year"),
    ),
)
def trend_fit_lines(spark, sf):
    panel = panels.supp_year(spark, sf)
    df = trend.fitted_values(panel, trend.fit_trends(panel))
    return df.select("indicator_key", "place_id", whole("period"), rounded("value"), rounded("fitted"))


_AHEAD = "(sg * target_value - sg * latest_value) / (sg * slope)"
_LAST = """CASE step_unit WHEN 'month' THEN {y} * 12 + 11 WHEN 'day'
    THEN date_diff('day', DATE '1970-01-01', make_date({y}, 12, 31)) ELSE {y} END"""
_CALENDAR = "CASE step_unit WHEN 'month' THEN {p} / 12 WHEN 'day' THEN 1970 + {p} / 365.2425::DOUBLE ELSE {p}::DOUBLE END"
_PROGRESS = f"""SELECT *, {_CALENDAR.format(p='projected_period')} AS projected_year,
    CAST(floor({_CALENDAR.format(p='latest_period')}) AS BIGINT) AS latest_year,
    projected_period <= {_LAST.format(y='target_year')} AS on_track FROM (
    SELECT *, CASE WHEN target_value IS NULL THEN NULL WHEN met IS NOT NULL THEN met
    WHEN slope IS NULL THEN NULL WHEN sg * slope <= 0 THEN 'inf'::DOUBLE
    WHEN {_AHEAD} <= 0 THEN latest_period
    WHEN latest_period + {_AHEAD} > {_LAST.format(y='2100')} THEN 'inf'::DOUBLE
    ELSE latest_period + {_AHEAD} END AS projected_period
    FROM (SELECT indicator_key, place_id, any_value(target_value) AS target_value, any_value(step_unit) AS step_unit,
          any_value(target_year) AS target_year, any_value(sg) AS sg, max_by(value, period) AS latest_value,
          max(period) AS latest_period, min(CASE WHEN sg * value >= sg * target_value THEN period END)::DOUBLE AS met
          FROM panel JOIN (SELECT *, CASE WHEN polarity = 'lower_is_better' THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS sg
          FROM targets) USING (indicator_key) GROUP BY ALL) LEFT JOIN trends USING (indicator_key, place_id))"""
_PROGRESS_TABLES = "cust_year supp_wide supp_year user_day nation_month panel settings targets centred trends progress"
_PANEL_COLUMNS = "indicator_key, place_id, period, date, value"
_PROGRESS_EXTRA = {
    **CTE, **_trend_tables("panel"), "progress": _PROGRESS,
    "panel": f"""SELECT {_PANEL_COLUMNS}, 'year' AS step_unit FROM cust_year UNION ALL
        SELECT {_PANEL_COLUMNS}, 'year' FROM supp_year UNION ALL SELECT {_PANEL_COLUMNS}, 'day' FROM user_day UNION ALL
        SELECT indicator_key, place_id, period, printf('%04d-%02d', period // 12, period % 12 + 1), value, 'month' FROM nation_month""",
    # The targets of day and month panels are steps in the settings; a target is a calendar year.
    "targets": """SELECT * REPLACE (CASE WHEN target_year > 24000 THEN target_year // 12 WHEN target_year > 19000
        THEN 1970 + (target_year - 365) // 365 ELSE target_year END AS target_year) FROM settings""",
}


def _stepped_panel(spark, sf):
    """Panels of years, months and days, each date written in its unit."""
    columns = ["indicator_key", "place_id", "period", "date", "value"]
    months = panels.nation_month(spark, sf).withColumn("date", steps.date_of(F.col("period"), F.lit(steps.MONTH)))
    parts = (panels.cust_year(spark, sf), panels.supp_year(spark, sf), panels.user_day(spark, sf), months)
    first, *rest = (p.select(*columns) for p in parts)
    for other in rest:
        first = first.unionByName(other)
    return first


def _progress(spark, sf):
    t = F.col("target_year")
    year = F.when(t > 24000, F.floor(t / 12)).when(t > 19000, 1970 + F.floor((t - 365) / 365)).otherwise(t)
    targets = panels.settings(spark).withColumn("target_year", year.cast("int"))
    return trend.progress(settle(_stepped_panel(spark, sf)), targets)


@query(
    "progress",
    with_tables(
        _PROGRESS_TABLES,
        """SELECT indicator_key, place_id, round(latest_value, 4) AS latest_value,
        CAST(latest_year AS BIGINT) AS latest_year,
        round(sg * (target_value - latest_value), 4) AS gap, round(slope, 6) AS slope,
        CASE WHEN projected_year = 'inf'::DOUBLE THEN 999999 ELSE round(projected_year, 6) END AS projected_year,
        step_unit, CAST(latest_period AS BIGINT) AS latest_period,
        coalesce(CAST(on_track AS VARCHAR), 'unknown') AS on_track FROM progress""",
        _PROGRESS_EXTRA,
    ),
)
def progress(spark, sf):
    year = F.col("projected_year")
    return _progress(spark, sf).select(
        "indicator_key", "place_id", rounded("latest_value", 4), whole("latest_year"),
        rounded("gap", 4), rounded("slope"),
        F.when(year == float("inf"), 999999.0).otherwise(F.round(year, 6)).alias("projected_year"),
        "step_unit", whole("latest_period"),
        F.coalesce(F.col("on_track").cast("string"), F.lit("unknown")).alias("on_track"),
    )


@query(
    "progress_table",
    with_tables(
        _PROGRESS_TABLES,
        """SELECT indicator_key, place_id, CASE WHEN place_id LIKE 'user/%' AND CAST(substr(place_id, 6) AS INTEGER) % 7 <> 0
        THEN 'User ' || substr(place_id, 6) ELSE place_id END AS country, CAST(latest_year AS BIGINT) AS latest_year,
        CAST(printf('%.1f', latest_value) AS DOUBLE) AS latest,
        CASE WHEN target_value IS NULL THEN NULL WHEN sg * (target_value - latest_value) <= 0 THEN 'Met'
             ELSE printf('%.1f', sg * (target_value - latest_value)) || ' remaining' END AS gap_to_target,
        CASE WHEN target_value IS NULL THEN NULL WHEN projected_year IS NULL THEN '—'
             WHEN projected_year = 'inf'::DOUBLE THEN 'Not at current pace'
             ELSE printf('%.0f', round(projected_year, 6)) END AS reaches_target,
        CASE WHEN target_year IS NULL THEN NULL WHEN projected_year IS NULL THEN '—'
             WHEN on_track THEN '✅ Yes' ELSE '❌ No' END AS on_track FROM progress""",
        _PROGRESS_EXTRA,
    ),
)
def progress_table(spark, sf):
    results = _progress(spark, sf).withColumn("projected_year", rounded("projected_year"))
    return trend.progress_table(results, panels.user_names(spark, sf)).withColumn(
        "latest_year", whole("latest_year")
    )


# ---- convergence ----

_T_TABLE = ", ".join(f"({i}, {t_975(i)!r}::DOUBLE)" for i in range(1, TABLE_UP_TO + 1))
_T_TAIL = f"{NORMAL_975}::DOUBLE + " + " + ".join(
    f"{c!r}::DOUBLE / (n_places - 2) ** {i}" for i, c in enumerate(expansion_terms(), start=1)
)
_CONVERGENCE = {
    "panel": f"""SELECT {_PANEL_COLUMNS} FROM cust_year UNION ALL SELECT {_PANEL_COLUMNS} FROM supp_year""",
    "span": "SELECT indicator_key, min(period) AS b, max(period) AS e FROM panel GROUP BY ALL",
    "ends": """SELECT x.indicator_key, x.place_id, x.value AS base_value, y.value AS end_value,
        y.value - x.value AS change FROM panel x JOIN span s ON x.indicator_key = s.indicator_key AND x.period = b
        JOIN panel y ON y.indicator_key = x.indicator_key AND y.place_id = x.place_id AND y.period = e""",
    "tq": f"SELECT * FROM (VALUES {_T_TABLE}) AS v(df, t)",
    "fit": """SELECT indicator_key, count(*) AS n_places, regr_slope(change, base_value) AS beta,
        regr_sxx(change, base_value) AS sxx, regr_syy(change, base_value) AS syy,
        regr_r2(change, base_value) AS r2, coalesce(avg(CASE WHEN saturation_ceiling IS NULL THEN NULL WHEN base_value >= saturation_ceiling - 0.5
        OR end_value >= saturation_ceiling - 0.5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 0) AS ceiling_share
        FROM ends LEFT JOIN settings USING (indicator_key) GROUP BY ALL HAVING count(*) >= 5""",
    "totals": "SELECT indicator_key, count(DISTINCT place_id) AS total_places FROM panel GROUP BY ALL",
    "middle": "SELECT indicator_key, median(base_value) AS m FROM ends GROUP BY ALL",
    "behind": """SELECT e.*, m, CASE WHEN polarity = 'higher_is_better' THEN change ELSE -change END AS improvement
        FROM ends e JOIN settings USING (indicator_key) JOIN middle USING (indicator_key)
        WHERE (polarity = 'higher_is_better' AND base_value <= m)
           OR (polarity = 'lower_is_better' AND base_value >= m)""",
}
_CONVERGENCE_TABLES = "cust_year supp_wide supp_year panel settings span ends"


def _ends(spark, sf):
    columns = ["indicator_key", "place_id", "period", "value"]
    panel = panels.cust_year(spark, sf).select(*columns).unionByName(
        panels.supp_year(spark, sf).select(*columns)
    )
    places, _ = convergence.endpoint_values(panel, convergence.series_endpoints(panel))
    return panel, places


@query(
    "convergence",
    with_tables(
        _CONVERGENCE_TABLES + " tq fit totals",
        f"""SELECT indicator_key, n_places, round(beta, 6) AS beta, round(beta - t * se, 6) AS beta_ci_low,
        round(beta + t * se, 6) AS beta_ci_high, round(r2, 6) AS r_squared, round(ceiling_share, 6) AS ceiling_share,
        total_places, n_places / total_places < 0.8 AS low_coverage
        FROM (SELECT *, sqrt(greatest(syy - beta * beta * sxx, 0) / (n_places - 2) / sxx) AS se,
              CASE WHEN n_places - 2 <= {TABLE_UP_TO} THEN t0 ELSE {_T_TAIL} END AS t
              FROM (SELECT fit.*, tq.t AS t0 FROM fit LEFT JOIN tq ON df = n_places - 2))
        JOIN totals USING (indicator_key)""",
        _CONVERGENCE,
    ),
)
def convergence_query(spark, sf):
    panel, places = _ends(spark, sf)
    df = convergence.convergence(places, panels.settings(spark), all_places=panel)
    return df.select(
        "indicator_key", "n_places", rounded("beta"), rounded("beta_ci_low"),
        rounded("beta_ci_high"), rounded("r_squared"), rounded("ceiling_share"), "total_places",
        "low_coverage",
    )


def _movers_sql(name: str, order: str) -> str:
    return f"""SELECT indicator_key, '{name}' AS list, row_number() OVER (PARTITION BY indicator_key
        ORDER BY improvement {order}, place_id) AS position, place_id, round(base_value, 6) AS base_value,
        round(end_value, 6) AS end_value, round(change, 6) AS change, round(improvement, 6) AS improvement FROM behind
        QUALIFY position <= 5"""


@query(
    "convergence_movers",
    with_tables(
        _CONVERGENCE_TABLES + " middle behind",
        _movers_sql("catching_up", "DESC") + " UNION ALL " + _movers_sql("falling_behind", "ASC"),
        _CONVERGENCE,
    ),
)
def convergence_movers(spark, sf):
    _, places = _ends(spark, sf)
    movers, _ = convergence.convergence_movers(places, panels.settings(spark))
    return movers.withColumns(
        {c: rounded(c) for c in ("base_value", "end_value", "change", "improvement")}
    )


@query(
    "convergence_pools",
    with_tables(
        _CONVERGENCE_TABLES + " middle behind",
        """SELECT indicator_key, count(*) AS n_behind, round(any_value(m), 6) AS behind_threshold
        FROM behind GROUP BY ALL""",
        _CONVERGENCE,
    ),
)
def convergence_pools(spark, sf):
    _, places = _ends(spark, sf)
    _, pools = convergence.convergence_movers(places, panels.settings(spark))
    return pools.select("indicator_key", "n_behind", rounded("behind_threshold"))
