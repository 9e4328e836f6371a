"""Queries on coverage, data quality, lineage and citations."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwright.functions import steps
from panelwright.operators import coverage, lineage, quality
from panelwright.plans import comparison, panels
from panelwright.plans.registry import ORACLES, query, rounded, whole, with_tables
from panelwright.schema import INDICATOR, literal_table
from panelwright.staging import settle

_BASE = "cust_year supp_wide supp_year settings"
CTE = {
    "panel": """SELECT indicator_key, place_id, period, date, value FROM cust_year UNION ALL
        SELECT indicator_key, place_id, period, date, value FROM supp_year""",
    "grid": """SELECT indicator_key, place_id, p AS period FROM (
        SELECT DISTINCT indicator_key, place_id, unnest(generate_series(temporal_start, temporal_end)) AS p
        FROM panel JOIN settings USING (indicator_key))""",
}


def _panel(spark, sf):
    columns = ["indicator_key", "place_id", "period", "date", "value"]
    return panels.cust_year(spark, sf).select(*columns).unionByName(
        panels.supp_year(spark, sf).select(*columns)
    )


# ---- coverage ----


@query(
    "coverage_report",
    with_tables(
        _BASE + " panel",
        """SELECT indicator_key, n_places_total, n_places_total * steps AS n_place_years_expected, n_place_years_observed,
        n_places_total * steps - n_place_years_observed AS n_missing_cells,
        round((n_places_total * steps - n_place_years_observed) / (n_places_total * steps), 6) AS missing_share
        FROM (SELECT indicator_key, count(DISTINCT place_id) AS n_places_total,
              count(DISTINCT (place_id, period)) AS n_place_years_observed,
              any_value(temporal_end - temporal_start + 1) AS steps
              FROM panel JOIN settings USING (indicator_key) GROUP BY ALL)""",
        CTE,
    ),
)
def coverage_report(spark, sf):
    df = coverage.coverage_report(_panel(spark, sf), panels.settings(spark))
    return df.withColumn("missing_share", rounded("missing_share"))


@query(
    "coverage_report_clipped",
    with_tables(
        _BASE + " panel",
        """SELECT indicator_key, n_places_total, n_places_total * steps AS n_place_years_expected, n_place_years_observed,
        n_places_total * steps - n_place_years_observed AS n_missing_cells,
        round((n_places_total * steps - n_place_years_observed) / (n_places_total * steps), 6) AS missing_share
        FROM (SELECT indicator_key, count(DISTINCT place_id) AS n_places_total,
              count(DISTINCT (place_id, period)) FILTER (period BETWEEN temporal_start AND temporal_end)
              AS n_place_years_observed, any_value(temporal_end - temporal_start + 1) AS steps
              FROM panel JOIN settings USING (indicator_key) GROUP BY ALL)""",
        CTE,
    ),
)
def coverage_report_clipped(spark, sf):
    df = coverage.coverage_report(_panel(spark, sf), panels.settings(spark), clip=True)
    return df.withColumn("missing_share", rounded("missing_share"))


@query(
    "coverage_stalest",
    with_tables(
        _BASE + " panel",
        """SELECT indicator_key, place_id, CAST(latest AS BIGINT) AS latest_period, position FROM (
        SELECT *, row_number() OVER (PARTITION BY indicator_key ORDER BY latest, place_id) AS position
        FROM (SELECT indicator_key, place_id, max(period) AS latest FROM panel GROUP BY ALL))
        WHERE position <= 10""",
        CTE,
    ),
)
def coverage_stalest(spark, sf):
    df = coverage.stalest_places(_panel(spark, sf))
    return df.select(INDICATOR, "place_id", whole("latest_period"), "position")


@query(
    "coverage_grid",
    with_tables(
        _BASE + " panel grid",
        """SELECT g.indicator_key, g.place_id, CAST(g.period AS BIGINT) AS period,
        CAST(CASE WHEN p.period IS NULL THEN 0 ELSE 1 END AS BIGINT) AS observed
        FROM grid g LEFT JOIN panel p USING (indicator_key, place_id, period)""",
        CTE,
    ),
)
def coverage_grid(spark, sf):
    df = coverage.coverage_grid(_panel(spark, sf), panels.settings(spark))
    return df.select(INDICATOR, "place_id", whole("period"), whole("observed"))


@query(
    "coverage_grid_wide",
    with_tables(
        "supp_wide supp_year settings panel grid",
        "SELECT indicator_key, place_id, "
        + ", ".join(
            f"CAST(coalesce(max(CASE WHEN period = {y} THEN o END), -1) AS BIGINT) AS y{y}"
            for y in range(1995, 2002)
        )
        + """ FROM (SELECT g.*, CASE WHEN p.period IS NULL THEN 0 ELSE 1 END AS o
        FROM grid g LEFT JOIN panel p USING (indicator_key, place_id, period)) GROUP BY ALL""",
        {**CTE, "panel": "SELECT * FROM supp_year"},
    ),
)
def coverage_grid_wide(spark, sf):
    years = list(range(1995, 2002))
    grid = coverage.coverage_grid(panels.supp_year(spark, sf), panels.settings(spark))
    wide = coverage.coverage_grid_wide(grid, years)
    return wide.select(
        INDICATOR, "place_id", *[F.coalesce(F.col(str(y)), F.lit(-1)).cast("bigint").alias(f"y{y}") for y in years]
    )


@query(
    "coverage_missing_cells",
    with_tables(
        _BASE + " panel grid",
        """SELECT indicator_key, place_id, CAST(period AS BIGINT) AS period
        FROM grid ANTI JOIN panel USING (indicator_key, place_id, period)""",
        CTE,
    ),
)
def coverage_missing_cells(spark, sf):
    df = coverage.missing_cells(_panel(spark, sf), panels.settings(spark))
    return df.withColumn("period", whole("period"))


@query(
    "join_audit",
    with_tables(
        "nation_points geometry",
        """SELECT indicator_key, count(*) AS n_observations, (SELECT count(*) FROM geometry) AS n_geometries,
        count(g.place_id) AS n_matched, count(*) = count(g.place_id) AS is_clean
        FROM nation_points n LEFT JOIN geometry g USING (place_id) GROUP BY ALL""",
    ),
)
def join_audit(spark, sf):
    return coverage.audit_join(panels.nation_points(spark, sf), panels.geometry(spark, sf))


@query(
    "join_audit_unmatched",
    with_tables(
        "nation_points geometry",
        """SELECT 'observation' AS side, indicator_key, place_id FROM nation_points
        WHERE place_id NOT IN (SELECT place_id FROM geometry) UNION ALL
        SELECT 'geometry', 'any', place_id FROM geometry
        WHERE place_id NOT IN (SELECT place_id FROM nation_points)""",
    ),
)
def join_audit_unmatched(spark, sf):
    points, shapes = panels.nation_points(spark, sf), panels.geometry(spark, sf)
    return (
        coverage.unmatched_places(points, shapes)
        .select(F.lit("observation").alias("side"), INDICATOR, "place_id")
        .unionByName(
            coverage.unmatched_geometry(points, shapes).select(
                F.lit("geometry").alias("side"), F.lit("any").alias(INDICATOR), "place_id"
            )
        )
    )


def _balance_sides(spark, sf):
    """Nations and bands of a hundred of balance that suppliers and customers have."""
    bands = lambda t, k, b: panels.table(spark, sf, t).select(
        F.concat(
            F.lit("nation/"), F.col(k).cast("string"), F.lit("/"), F.floor(F.col(b) / 100).cast("string")
        ).alias("place_id")
    )
    return bands("supplier", "s_nationkey", "s_acctbal"), bands("customer", "c_nationkey", "c_acctbal")


_ASYMMETRY = {
    side: f"""SELECT DISTINCT 'nation/' || {p}_nationkey || '/' || CAST(floor({p}_acctbal / 100) AS BIGINT) AS place_id FROM {table}"""
    for side, p, table in (("l", "s", "supplier"), ("r", "c", "customer"))
}


@query(
    "coverage_asymmetry",
    with_tables(
        "l r",
        """SELECT place_id, 'left_only' AS side FROM l ANTI JOIN r USING (place_id) UNION ALL
        SELECT place_id, 'right_only' FROM r ANTI JOIN l USING (place_id)""",
        _ASYMMETRY,
    ),
)
def coverage_asymmetry(spark, sf):
    return coverage.coverage_asymmetry(*_balance_sides(spark, sf))


_ASKED = [
    ("ship/share_r", "ship/revenue"), ("orders/finished", "ship/share_r"), ("supplier/balance", "customer/debt"),
    ("customer/debt", "customer/credit"), ("ship/none", "customer/debt"),
]


@query(
    "coverage_asymmetries",
    with_tables(
        "cust_year supp_wide supp_year nation_points have asked",
        """SELECT left_key, right_key, place_id, 'left_only' AS side FROM asked JOIN have ON left_key = k
        WHERE NOT EXISTS (SELECT 1 FROM have h WHERE h.k = right_key AND h.place_id = have.place_id) UNION ALL
        SELECT left_key, right_key, place_id, 'right_only' FROM asked JOIN have ON right_key = k
        WHERE NOT EXISTS (SELECT 1 FROM have h WHERE h.k = left_key AND h.place_id = have.place_id)""",
        {
            "have": """SELECT indicator_key AS k, place_id FROM cust_year UNION SELECT indicator_key, place_id FROM supp_year
            UNION SELECT indicator_key, place_id FROM nation_points""",
            "asked": "SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _ASKED) + ") AS v(left_key, right_key)",
        },
    ),
)
def coverage_asymmetries(spark, sf):
    """All asked pairs in one pass over the panels."""
    keys = [INDICATOR, "place_id"]
    panel = panels.cust_year(spark, sf).select(*keys).unionByName(panels.supp_year(spark, sf).select(*keys))
    panel = panel.unionByName(panels.nation_points(spark, sf).select(*keys))
    return coverage.coverage_asymmetries(panel, literal_table(spark, _ASKED, "left_key string, right_key string"))


@query(
    "coverage_asymmetry_finding",
    with_tables(
        "l r",
        """SELECT 'info' AS level, 'COVERAGE_ASYMMETRY' AS code,
        a || ' places only on the left, ' || b || ' only on the right' AS message FROM
        (SELECT (SELECT count(*) FROM l ANTI JOIN r USING (place_id)) AS a,
                (SELECT count(*) FROM r ANTI JOIN l USING (place_id)) AS b)""",
        _ASYMMETRY,
    ),
)
def coverage_asymmetry_finding(spark, sf):
    return coverage.coverage_asymmetry_finding(*_balance_sides(spark, sf)).drop("evidence")


# ---- rows dropped, rows filtered ----

_SIZED = {
    "sized": """SELECT 'cust/' || c_custkey AS place_id, c_acctbal AS value, population FROM customer LEFT JOIN
        (SELECT o_custkey, sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) AS population FROM orders
         GROUP BY ALL) ON c_custkey = o_custkey"""
}


def _sized(spark, sf):
    orders = (
        panels.table(spark, sf, "orders")
        .groupBy(F.col("o_custkey").alias("c_custkey"))
        .agg(F.sum(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))).alias("population"))
    )
    return panels.table(spark, sf, "customer").join(orders, "c_custkey", "left").select(
        F.concat(F.lit("cust/"), F.col("c_custkey").cast("string")).alias("place_id"),
        F.col("c_acctbal").alias("value"),
        "population",
    )


@query(
    "drop_missing_report",
    with_tables(
        "sized",
        """SELECT n_before, n_after, n_before - n_after AS n_dropped, 'no finished orders' AS reason,
        'Excluded ' || (n_before - n_after) || ' rows: no finished orders (n=' || (n_before - n_after)
        || ' of ' || n_before || ')' AS message
        FROM (SELECT count(*) AS n_before, count(population) AS n_after FROM sized)""",
        _SIZED,
    ),
)
def drop_missing_report(spark, sf):
    return quality.drop_missing(
        _sized(spark, sf), ["value", "population"], "no finished orders"
    ).report


@query(
    "drop_missing_places",
    with_tables("sized", "SELECT place_id FROM sized WHERE population IS NULL", _SIZED),
)
def drop_missing_places(spark, sf):
    return quality.drop_missing(
        _sized(spark, sf), ["value", "population"], "no finished orders"
    ).places


@query(
    "filter_report",
    """SELECT count(*) AS n_before, count(*) FILTER (o_orderstatus = 'F') AS n_after, 'info' AS level,
    'FILTER_APPLIED' AS code FROM orders""",
)
def filter_report(spark, sf):
    df = quality.filter_report(
        panels.table(spark, sf, "orders"), F.col("o_orderstatus") == "F", "finished orders"
    )
    return df.select("n_before", "n_after", "level", "code")


@query(
    "duplicate_cells",
    """SELECT 'orders/customer_day' AS indicator_key, 'error' AS level, 'DUPLICATE_CELL' AS code,
    '{"n_cells":' || count(*) || ',"n_rows":' || CAST(sum(n) AS BIGINT) || '}' AS evidence FROM
    (SELECT o_custkey, o_orderdate, count(*) AS n FROM orders GROUP BY ALL HAVING count(*) > 1)
    HAVING count(*) > 0""",
)
def duplicate_cells(spark, sf):
    rows = panels.table(spark, sf, "orders").select(
        F.lit("orders/customer_day").alias(INDICATOR),
        F.col("o_custkey").cast("string").alias("place_id"),
        F.datediff("o_orderdate", F.lit("1970-01-01").cast("date")).alias("period"),
    )
    return quality.duplicate_cells(rows).drop("message")


# ---- checks of pulls ----

_ID = "^user/[0-9]+$"
_PULL = {
    "facts": """SELECT p.*, coalesce(n, 0) AS n_places, latest_date, first_date, coalesce(n_dates, 0) AS n_dates,
        coalesce(n_facets, 0) AS n_facets, drifted, coalesce(n_out, 0) AS n_out, coalesce(n_bad, 0) AS n_bad
        FROM pulls p LEFT JOIN (SELECT l.indicator_key, count(*) AS n, max(date) AS latest_date,
        min(date) AS first_date, count(DISTINCT date) AS n_dates, count(DISTINCT facet_id) AS n_facets,
        min(l.unit) FILTER (l.unit <> q.unit) AS drifted,
        count(*) FILTER (value < value_min - 1e-6 OR value > value_max + 1e-6) AS n_out,
        count(*) FILTER (NOT regexp_matches(place_id, '^user/[0-9]+$')) AS n_bad
        FROM latest_point l JOIN pulls q USING (indicator_key) GROUP BY ALL) USING (indicator_key)""",
    "found": """SELECT indicator_key, 'error' AS level, 'EMPTY_VARIABLE' AS code, indicator_key || ' returned no places' AS message
        FROM facts WHERE n_places = 0
        UNION ALL SELECT indicator_key, 'error', 'MALFORMED_PLACE_ID',
            indicator_key || ': ' || n_bad || ' place ids cannot be joined' FROM facts WHERE n_bad > 0
        UNION ALL SELECT indicator_key, 'error', 'UNIT_DRIFT',
            indicator_key || ': expected unit ' || unit || ', got ' || drifted FROM facts WHERE drifted IS NOT NULL
        UNION ALL SELECT indicator_key, 'error', 'RANGE_VIOLATION',
            indicator_key || ': ' || n_out || ' values outside the known range' FROM facts WHERE n_out > 0
        UNION ALL SELECT indicator_key, 'warn', 'PLACE_COVERAGE_DROP',
            indicator_key || ': ' || n_places || ' places, ' || place_coverage || ' expected' FROM facts
            WHERE place_coverage > 0 AND n_places < place_coverage * 0.9
        UNION ALL SELECT indicator_key, 'warn', 'MULTI_FACET',
            indicator_key || ' mixes ' || n_facets || ' facets over ' || n_places || ' places' FROM facts WHERE n_facets > 1
        UNION ALL SELECT indicator_key, 'warn', 'MIXED_DATES',
            indicator_key || ': latest dates run from ' || first_date || ' to ' || latest_date FROM facts WHERE n_dates > 1""",
    "states": """SELECT f.indicator_key, f.label, f.source, f.upstream_source, f.n_places, f.latest_date,
        coalesce(n, 0) AS n_findings, CASE WHEN bad > 0 THEN 'fail' WHEN n > 0 THEN 'warn' ELSE 'pass' END AS status
        FROM facts f LEFT JOIN (SELECT indicator_key, count(*) AS n, count(*) FILTER (level = 'error') AS bad
        FROM found GROUP BY ALL) USING (indicator_key)""",
}


def _pull(spark, sf, examples=True):
    latest, wanted = panels.latest_point(spark, sf), panels.pulls(spark)
    facts = quality.pull_facts(latest, wanted, _ID)
    found = quality.pull_findings(latest, wanted, _ID, facts=facts, examples=examples)
    return latest, wanted, facts, found


@query(
    "pull_findings",
    with_tables("latest_point pulls facts found", "SELECT * FROM found", _PULL),
)
def pull_findings(spark, sf):
    return _pull(spark, sf)[3].drop("evidence")


@query(
    "pull_examples",
    with_tables(
        "latest_point pulls",
        """SELECT indicator_key, code, string_agg(place_id, ',' ORDER BY place_id) AS examples FROM (
        SELECT *, row_number() OVER (PARTITION BY indicator_key, code ORDER BY place_id) AS rn FROM (
        SELECT l.indicator_key, 'RANGE_VIOLATION' AS code, place_id FROM latest_point l JOIN pulls USING (indicator_key)
        WHERE value < value_min - 1e-6 OR value > value_max + 1e-6 UNION ALL
        SELECT l.indicator_key, 'MALFORMED_PLACE_ID', place_id FROM latest_point l JOIN pulls USING (indicator_key)
        WHERE NOT regexp_matches(place_id, '^user/[0-9]+$'))) WHERE rn <= 5 GROUP BY ALL""",
    ),
)
def pull_examples(spark, sf):
    found = _pull(spark, sf)[3]
    parsed = F.from_json(
        "evidence", F.lit("struct<examples:array<string>>")
    )
    plain = F.transform(
        parsed["examples"],
        lambda e: F.coalesce(F.get_json_object(e, "$.place_id"), e),
    )
    return found.where(F.col("code").isin("RANGE_VIOLATION", "MALFORMED_PLACE_ID")).select(
        INDICATOR, "code", F.array_join(plain, ",").alias("examples")
    )


@query(
    "pull_status",
    with_tables("latest_point pulls facts found states", "SELECT * FROM states", _PULL),
)
def pull_status(spark, sf):
    _, wanted, facts, found = _pull(spark, sf, examples=False)
    return quality.pull_status(facts, found, wanted).drop("error")


@query(
    "pull_status_summary",
    with_tables(
        "latest_point pulls facts found states",
        """SELECT count(*) FILTER (status = 'pass') AS pass, count(*) FILTER (status = 'warn') AS warn,
        count(*) FILTER (status = 'fail') AS fail, count(*) FILTER (status = 'fail') = 0 AS batch_ok FROM states""",
        _PULL,
    ),
)
def pull_status_summary(spark, sf):
    _, wanted, facts, found = _pull(spark, sf, examples=False)
    return quality.status_summary(quality.pull_status(facts, found, wanted))


@query(
    "sources_report",
    with_tables(
        "latest_point pulls pull_sources facts found states",
        """SELECT s.source, source_label, indicator_key, label AS indicator_label, status,
        CASE WHEN indicator_key IS NOT NULL THEN coalesce(upstream_source, source_label) END AS produced_by,
        coalesce(n_places, -1) AS n_places, coalesce(latest_date, '—') AS latest_date
        FROM pull_sources s LEFT JOIN states USING (source)""",
        _PULL,
    ),
)
def sources_report(spark, sf):
    _, wanted, facts, found = _pull(spark, sf, examples=False)
    status = quality.pull_status(facts, found, wanted)
    df = quality.sources_report(panels.pull_sources(spark), status)
    return df.withColumn("n_places", F.coalesce("n_places", F.lit(-1).cast("bigint")))


@query(
    "mixed_dates",
    with_tables(
        "latest_point",
        """SELECT indicator_key, 'warn' AS level, 'MIXED_DATES' AS code, count(DISTINCT date) || ' dates from '
        || min(date) || ' to ' || max(date) AS message FROM latest_point GROUP BY ALL HAVING count(DISTINCT date) > 1""",
    ),
)
def mixed_dates(spark, sf):
    return quality.mixed_dates(panels.latest_point(spark, sf)).drop("evidence")


# ---- values and aggregates ----


@query(
    "ceiling_effect",
    with_tables(
        _BASE + " panel latest",
        """SELECT indicator_key, count(*) FILTER (value >= saturation_ceiling - 0.5) AS n_saturated,
        count(*) AS n_total, round(count(*) FILTER (value >= saturation_ceiling - 0.5) / count(*), 6) AS share,
        'warn' AS level, 'CEILING_EFFECT' AS code FROM latest JOIN settings USING (indicator_key)
        WHERE saturation_ceiling IS NOT NULL GROUP BY ALL
        HAVING count(*) FILTER (value >= saturation_ceiling - 0.5) / count(*) > 0.1""",
        {
            **CTE,
            "latest": """SELECT indicator_key, place_id, max_by(value, period) AS value FROM panel GROUP BY ALL""",
        },
    ),
)
def ceiling_effect(spark, sf):
    latest = _panel(spark, sf).groupBy(INDICATOR, "place_id").agg(
        F.max_by("value", "period").alias("value")
    )
    df = quality.ceiling_effect(latest, panels.settings(spark), threshold=0.1)
    return df.select(
        INDICATOR, "n_saturated", "n_total", rounded("share"), "level", "code"
    )


@query(
    "panel_mean_unweighted",
    with_tables(
        "cust_year supp_wide supp_year panel",
        """SELECT indicator_key, CAST(period AS BIGINT) AS period, round(avg(value), 6) AS mean,
        'UNWEIGHTED_AGGREGATE' AS code FROM panel GROUP BY ALL""",
        CTE,
    ),
)
def panel_mean_unweighted(spark, sf):
    mean, finding = quality.panel_mean(_panel(spark, sf))
    return mean.join(finding.select(INDICATOR, "code"), INDICATOR).select(
        INDICATOR, whole("period"), rounded("mean"), "code"
    )


def _supp_weights(spark, sf):
    return (
        panels.supp_year(spark, sf)
        .where(F.col(INDICATOR) == "ship/quantity")
        .select("place_id", "period", F.col("value").alias("weight"))
    )


@query(
    "panel_mean_weighted",
    with_tables(
        "supp_wide supp_year",
        """SELECT s.indicator_key, CAST(s.period AS BIGINT) AS period, round(sum(value * quantity) / sum(quantity), 6) AS mean
        FROM supp_year s JOIN supp_wide w USING (place_id, period) GROUP BY ALL""",
    ),
)
def panel_mean_weighted(spark, sf):
    mean, _ = quality.panel_mean(panels.supp_year(spark, sf), _supp_weights(spark, sf))
    return mean.select(INDICATOR, whole("period"), rounded("mean"))


# A published figure for every year, of two indicators and of one that is not there.
_PUBLISHED = [
    (f"{key}@{year}", figure)
    for year in range(1992, 2002)
    for key, figure in (("ship/share_r", 33.3), ("ship/share_a", 50.0), ("ship/none", 1.0))
]


@query(
    "weighted_mean_check",
    with_tables(
        "supp_wide supp_year published",
        """SELECT indicator_key, CASE WHEN abs(m - published) <= 0.5 THEN 'info' ELSE 'error' END AS level,
        CASE WHEN m IS NULL THEN 'CROSS_CHECK_FAILED' ELSE 'HEADLINE_CROSS_CHECK' END AS code,
        round(m, 6) AS weighted_mean, published, round(abs(m - published), 6) AS delta
        FROM published LEFT JOIN (SELECT s.indicator_key || '@' || period AS indicator_key, sum(value * quantity) / sum(quantity) AS m
        FROM supp_year s JOIN supp_wide USING (place_id, period) GROUP BY ALL) USING (indicator_key)""",
        {"published": "SELECT * FROM (VALUES " + ", ".join(f"('{k}', {v}::DOUBLE)" for k, v in _PUBLISHED) + ") AS v(indicator_key, published)"},
    ),
)
def weighted_mean_check(spark, sf):
    at = lambda c: F.concat(c, F.lit("@"), F.col("period").cast("string")).alias(c)
    published = literal_table(spark, _PUBLISHED, "indicator_key string, published double")
    df = quality.weighted_mean_check(
        panels.supp_year(spark, sf).select(at(INDICATOR), at("place_id"), "value"),
        _supp_weights(spark, sf).select(at("place_id"), "weight"),
        published,
    )
    return df.select(
        INDICATOR, "level", "code", rounded("weighted_mean"), "published", rounded("delta")
    )


# ---- lineage ----

_LINEAGE_PANEL = {
    "lp": """SELECT *, 'prov/' || facet_id AS provenance_id FROM latest_point""",
    "shapes": """SELECT CASE WHEN max(value) < 300 THEN 'user/' ELSE 'busy/' END || user_id AS place_id FROM events GROUP BY user_id
        UNION ALL SELECT CASE WHEN c_acctbal > 0 THEN 'cust/' ELSE 'debtor/' END || c_custkey FROM customer""",
}


def _lineage_panel(spark, sf):
    return panels.latest_point(spark, sf).withColumns(
        {
            "provenance_id": F.concat(F.lit("prov/"), "facet_id"),
            "provenance_url": F.lit(None).cast("string"),
            "observation_period": F.lit("P1Y"),
        }
    )


def _shapes(spark, sf):
    users = (
        panels.table(spark, sf, "events")
        .groupBy("user_id")
        .agg(F.max("value").alias("_top"))
        .select(
            F.concat(F.when(F.col("_top") < 300, "user/").otherwise("busy/"), F.col("user_id").cast("string")).alias("place_id")
        )
    )
    owner = F.when(F.col("c_acctbal") > 0, "cust/").otherwise("debtor/")
    customers = panels.table(spark, sf, "customer")
    return users.unionByName(customers.select(F.concat(owner, F.col("c_custkey").cast("string")).alias("place_id")))


_CHECKS = {
            **_LINEAGE_PANEL,
            "audit": """SELECT indicator_key, place_id, s.place_id IS NOT NULL AS drawn
                FROM lp LEFT JOIN shapes s USING (place_id)""",
            "units": """SELECT DISTINCT l.indicator_key, l.unit, p.unit AS want FROM lp l JOIN pulls p USING (indicator_key)""",
            "facets": "SELECT indicator_key, facet_id, count(*) AS n FROM lp GROUP BY ALL",
            "years": """SELECT *, max(n) OVER (PARTITION BY indicator_key) AS top FROM (
                SELECT indicator_key, date, count(*) AS n FROM lp GROUP BY ALL)""",
            "all_checks": """
            SELECT a.indicator_key, 'map_join' AS "check", count(*) FILTER (drawn) AS agree, count(*) AS total,
                count(*) FILTER (NOT drawn) = 0 AS passed, coalesce(any_value(o), '') AS offenders, CAST(NULL AS VARCHAR) AS note
            FROM audit a LEFT JOIN (SELECT indicator_key, string_agg(place_id, ',' ORDER BY place_id) AS o FROM (
                SELECT *, row_number() OVER (PARTITION BY indicator_key ORDER BY place_id) AS rn FROM audit WHERE NOT drawn)
                WHERE rn <= 8 GROUP BY ALL) USING (indicator_key) GROUP BY ALL
            UNION ALL SELECT indicator_key, 'catalog_coverage', least(place_coverage, n), greatest(place_coverage, n),
                place_coverage = n, '', CASE WHEN place_coverage <> n THEN place_coverage || ' → ' || n END
            FROM (SELECT p.*, (SELECT count(*) FROM lp WHERE lp.indicator_key = p.indicator_key) AS n FROM pulls p)
            WHERE place_coverage > 0
            UNION ALL SELECT p.indicator_key, 'unit_drift', count(*) FILTER (u.unit = p.unit),
                greatest(count(u.unit), 1), count(*) FILTER (u.unit <> p.unit) = 0,
                coalesce(string_agg(u.unit, ',' ORDER BY u.unit) FILTER (u.unit <> p.unit), ''), NULL
            FROM pulls p LEFT JOIN units u USING (indicator_key) GROUP BY ALL
            UNION ALL SELECT indicator_key, 'single_facet', max(n), CAST(sum(n) AS BIGINT), count(*) <= 1,
                coalesce((list_sort(list(facet_id))[2:]).list_reduce(lambda x, y: x || ',' || y), ''), NULL FROM facets GROUP BY ALL
            UNION ALL SELECT indicator_key, 'same_year', any_value(top), CAST(sum(n) AS BIGINT), count(*) <= 1,
                coalesce(array_to_string((list_sort(list(date) FILTER (n <> top)))[1:8], ','), ''), NULL FROM years GROUP BY ALL""",
        }


@query(
    "lineage_checks",
    with_tables(
        "latest_point pulls lp shapes audit units facets years all_checks",
        """SELECT *, round(coalesce(agree / nullif(total, 0), 0), 6) AS share FROM all_checks""",
        _CHECKS,
    ),
)
def lineage_checks(spark, sf):
    df = lineage.lineage_checks(
        _lineage_panel(spark, sf), panels.pulls(spark), _shapes(spark, sf)
    )
    return df.withColumns(
        {"offenders": F.array_join("offenders", ","), "share": rounded("share")}
    )


@query(
    "lineage_failing",
    with_tables(
        "latest_point pulls lp shapes audit units facets years all_checks",
        """SELECT indicator_key, count(*) FILTER (NOT passed) AS n_failing, count(*) AS n_checks
        FROM all_checks GROUP BY ALL""",
        _CHECKS,
    ),
)
def lineage_failing(spark, sf):
    return lineage.failing_checks(
        lineage.lineage_checks(_lineage_panel(spark, sf), panels.pulls(spark), _shapes(spark, sf))
    )


@query(
    "non_dominant_facets",
    with_tables(
        "latest_point facets",
        """SELECT indicator_key, facet_id AS facet, n AS n_values, d AS dominant_facet FROM (
        SELECT *, first_value(facet_id) OVER (PARTITION BY indicator_key ORDER BY n DESC, facet_id) AS d FROM facets)
        WHERE facet_id <> d""",
        {"facets": "SELECT indicator_key, facet_id, count(*) AS n FROM latest_point GROUP BY ALL"},
    ),
)
def non_dominant_facets(spark, sf):
    return lineage.non_dominant_facets(panels.latest_point(spark, sf))


def _cited(spark):
    return panels.pulls(spark).withColumns(
        {
            "source_agency": F.nullif("source", F.lit("api_b")),
            "provenance_id": F.concat(F.lit("own/"), "source"),
            "provenance_url": F.concat(F.lit("https://example.org/"), "source"),
            "unit_display": F.lit(None).cast("string"),
        }
    )


@query(
    "source_rows",
    with_tables(
        "latest_point pulls lp",
        """SELECT provenance_id AS id, max_by(upper(coalesce(nullif(source, 'api_b'), '—')), indicator_key) AS agency,
        string_agg(label, ', ' ORDER BY indicator_key) AS provides, 'P1Y' AS period,
        max_by('https://example.org/' || source, indicator_key) AS url
        FROM (SELECT DISTINCT indicator_key, facet_id, provenance_id FROM lp) JOIN pulls USING (indicator_key)
        GROUP BY ALL""",
        _LINEAGE_PANEL,
    ),
)
def source_rows(spark, sf):
    return lineage.source_rows(_lineage_panel(spark, sf), _cited(spark))


@query(
    "lineage_counts",
    with_tables(
        "latest_point pulls shapes",
        """SELECT (SELECT count(*) FROM latest_point) AS places, (SELECT count(DISTINCT place_id) FROM shapes) AS geometries,
        (SELECT count(*) FROM pulls) AS indicators, (SELECT count(DISTINCT source) FROM pulls) AS sources""",
        _LINEAGE_PANEL,
    ),
)
def lineage_counts(spark, sf):
    return lineage.lineage_counts(
        panels.latest_point(spark, sf), _shapes(spark, sf), _cited(spark)
    )


_REPORT = {
    **_CHECKS,
    "agreement": ORACLES["cross_source_agreement"],
    "meta": "SELECT *, 'own/' || indicator_key AS variable_id FROM pulls",
    "report": """SELECT 'check' AS section, indicator_key, "check" AS name, agree || '/' || total || ' ' || passed AS text FROM all_checks
        UNION ALL SELECT 'check', left_key, 'cross_source', agree || '/' || total || ' ' || passed FROM agreement
        UNION ALL SELECT 'field', indicator_key, label, variable_id FROM meta
        UNION ALL SELECT 'selection', indicator_key, unnest(['variable', 'parentEntity', 'childType']), unnest([variable_id, 'Earth', 'Country']) FROM meta
        UNION ALL SELECT 'step', indicator_key, 'transform.' || s, CAST(i AS VARCHAR) FROM (SELECT indicator_key, unnest(l) AS s, unnest(range(len(l))) AS i FROM (
            SELECT indicator_key, ['fetch', 'latest', 'long', 'names', 'join'] || CASE WHEN unit = 'Percent' THEN ['saturation'] ELSE [] END
            || CASE WHEN source = 'api_b' THEN ['merge'] ELSE [] END AS l FROM meta))
        UNION ALL SELECT 'source', NULL, id, provides FROM (SELECT provenance_id AS id, string_agg(label, ', ' ORDER BY indicator_key) AS provides
            FROM (SELECT DISTINCT indicator_key, facet_id, provenance_id FROM lp) JOIN pulls USING (indicator_key) GROUP BY ALL)
        UNION ALL SELECT 'count', NULL, 'places', CAST(count(*) AS VARCHAR) FROM lp
        UNION ALL SELECT 'count', NULL, 'geometries', CAST(count(DISTINCT place_id) AS VARCHAR) FROM shapes
        UNION ALL SELECT 'count', NULL, 'indicators', CAST(count(*) AS VARCHAR) FROM pulls
        UNION ALL SELECT 'count', NULL, 'sources', CAST(count(DISTINCT source) AS VARCHAR) FROM pulls""",
}


@query(
    "lineage_report",
    with_tables(
        "latest_point pulls lp shapes audit units facets years all_checks agreement meta report", "SELECT * FROM report", _REPORT
    ),
)
def lineage_report(spark, sf):
    """All parts of the lineage as rows: what was selected, done and counted, and every check with the cross-source ones."""
    meta = _cited(spark).withColumns(
        {
            "variable_id": F.concat(F.lit("own/"), INDICATOR),
            "saturation_ceiling": F.when(F.col("unit") == "Percent", 100.0),
            "denominator": F.lit(None).cast("string"),
        }
    )
    agreement = comparison.compare.cross_source_agreement(comparison._points(spark, sf))
    found = lineage.build_lineage(
        settle(_lineage_panel(spark, sf)), meta, _shapes(spark, sf), meta.where(F.col("source") == "api_b"), agreement
    )
    none = F.lit(None).cast("string")
    part = lambda df, section, key, name, text: df.select(
        F.lit(section).alias("section"), key.alias(INDICATOR), name.alias("name"), text.cast("string").alias("text")
    )
    key, name = F.col(INDICATOR), F.col("name")
    chosen = found.selection.where(F.col("parameter").isin("variable", "parentEntity", "childType"))
    counts = found.counts.select(F.expr("stack(4, 'places', places, 'geometries', geometries, 'indicators', indicators, 'sources', sources) AS (name, n)"))
    parts = [
        part(found.checks, "check", key, F.col("check"), F.concat("agree", F.lit("/"), "total", F.lit(" "), F.col("passed").cast("string"))),
        part(found.fields, "field", key, F.col("shown"), F.col("field")),
        part(chosen, "selection", key, F.col("parameter"), F.col("value")),
        part(found.transformations, "step", key, F.col("step"), F.col("position")),
        part(found.sources, "source", none, F.col("id"), F.col("provides")),
        part(counts, "count", none, name, F.col("n")),
    ]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


@query(
    "citations",
    with_tables(
        "latest_point pulls modal",
        """SELECT indicator_key, concat_ws(' ', label, '· https://example.org/' || source, '· unit: ' || unit,
        '· ' || as_of) AS citation FROM pulls LEFT JOIN modal USING (indicator_key)""",
        {
            "modal": """SELECT indicator_key, min_by(date, (-n, date)) AS as_of FROM
            (SELECT indicator_key, date, count(*) AS n FROM latest_point GROUP BY ALL) GROUP BY ALL"""
        },
    ),
)
def citations(spark, sf):
    from panelwright.operators.bins import modal_date

    as_of = modal_date(panels.latest_point(spark, sf)).withColumnRenamed("modal_date", "as_of")
    return lineage.citations(_cited(spark), as_of).select(INDICATOR, "citation")


@query(
    "cited_rows",
    with_tables(
        "latest_point",
        "SELECT indicator_key, count(*) AS n_rows, round(sum(value), 2) AS total FROM latest_point GROUP BY ALL",
    ),
)
def cited_rows(spark, sf):
    rows = lineage.require_citations(
        panels.latest_point(spark, sf), lineage.citations(_cited(spark))
    )
    return rows.groupBy(INDICATOR).agg(
        F.count("*").alias("n_rows"), F.round(F.sum("value"), 2).alias("total")
    )


# ---- one axis per indicator ----

_MIXED = """SELECT 'mixed/orders' AS indicator_key, place_id, date, value FROM cust_year UNION ALL
    SELECT 'mixed/orders', place_id, printf('%04d-%02d', period // 12, period % 12 + 1), value FROM nation_month UNION ALL
    SELECT 'quarters/orders', place_id, printf('%04d-Q%d', period // 12, period % 12 // 3 + 1), value FROM nation_month WHERE period % 3 = 0 UNION ALL
    SELECT 'quarters/orders', place_id, 'spring', value FROM nation_month WHERE period % 12 = 5 UNION ALL
    SELECT 'declared/orders', place_id, printf('%04d-%02d', period // 12, period % 12 + 1), value FROM nation_month WHERE period % 3 = 1 UNION ALL
    SELECT indicator_key, place_id, replace(date, '-', ''), value FROM user_day"""
_STEPPED = """SELECT *, CASE WHEN date = 'spring' THEN NULL WHEN indicator_key LIKE 'events/%' THEN 'day' WHEN indicator_key IN ('quarters/orders', 'declared/orders')
    THEN 'quarter' WHEN length(date) = 4 THEN 'year' ELSE 'month' END AS u FROM mixed"""


def _mixed(spark, sf):
    months = panels.nation_month(spark, sf)
    step = F.col("period")

    def rows(df, key, date, period="P1Y"):
        key = F.lit(key) if key else F.col(INDICATOR)
        return df.select(
            key.alias(INDICATOR), "place_id", F.lit(None).cast("int").alias("period"), date.alias("date"), "value",
            F.lit(period).alias("observation_period"),
        )

    month = steps.date_of(step, F.lit(steps.MONTH))
    quarter = steps.date_of(F.floor(step / 3).cast("int"), F.lit(steps.QUARTER))
    parts = [
        rows(panels.cust_year(spark, sf), "mixed/orders", F.col("date")),
        rows(months, "mixed/orders", month, None),
        rows(months.where(step % 3 == 0), "quarters/orders", quarter, None),
        rows(months.where(step % 12 == 5), "quarters/orders", F.lit("spring"), None),
        rows(months.where(step % 3 == 1), "declared/orders", month, "P3M"),
        rows(panels.user_day(spark, sf), None, F.replace("date", F.lit("-"), F.lit("")), "P1D"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query(
    "step_unit_panel",
    with_tables(
        "cust_year nation_month user_day mixed stepped units",
        """SELECT indicator_key, place_id, date, u AS step_unit, CAST(CASE u WHEN 'year' THEN CAST(date AS INTEGER)
        WHEN 'quarter' THEN CAST(substr(date, 1, 4) AS INTEGER) * 4 + CASE WHEN date LIKE '%Q%' THEN CAST(right(date, 1) AS INTEGER) - 1
            ELSE (CAST(right(date, 2) AS INTEGER) - 1) // 3 END
        WHEN 'month' THEN CAST(substr(date, 1, 4) AS INTEGER) * 12 + CAST(right(date, 2) AS INTEGER) - 1
        ELSE date_diff('day', DATE '1970-01-01', CAST(strptime(date, '%Y%m%d') AS DATE)) END AS BIGINT) AS period
        FROM stepped JOIN units USING (indicator_key) WHERE u = step_unit""",
        {
            "mixed": _MIXED, "stepped": _STEPPED,
            "units": """SELECT indicator_key, arg_min(u, (-n, CASE u WHEN 'year' THEN 1 WHEN 'quarter' THEN 2 WHEN 'month' THEN 3 ELSE 4 END)) AS step_unit
            FROM (SELECT indicator_key, u, count(*) AS n FROM stepped WHERE u IS NOT NULL GROUP BY ALL) GROUP BY ALL""",
        },
    ),
)
def step_unit_panel(spark, sf):
    """Every row on its indicator's axis: years, quarters, months, days and compact days."""
    found = quality.one_step_unit(_mixed(spark, sf)).panel
    return found.select(INDICATOR, "place_id", "date", "step_unit", whole("period"))


@query(
    "step_unit_findings",
    with_tables(
        "cust_year nation_month user_day mixed stepped",
        """SELECT indicator_key, CASE WHEN u IS NULL THEN 'UNREADABLE_DATE' ELSE 'MIXED_STEPS' END AS code,
        count(*) || ' rows are not on the axis of the indicator' AS message
        FROM stepped WHERE u IS NULL OR u <> (SELECT mode FROM (SELECT indicator_key AS k, arg_min(u, (-n, u = 'month')) AS mode
            FROM (SELECT indicator_key, u, count(*) AS n FROM stepped WHERE u IS NOT NULL GROUP BY ALL) GROUP BY ALL) WHERE k = indicator_key)
        GROUP BY indicator_key, u""",
        {"mixed": _MIXED, "stepped": _STEPPED},
    ),
)
def step_unit_findings(spark, sf):
    return quality.one_step_unit(_mixed(spark, sf)).findings.drop("level", "evidence")
