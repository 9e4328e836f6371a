"""Queries on comparability, priority ranking, bins, wide tables and groups of places."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwright.functions import order_stats
from panelwright.functions.order_stats import exact_quantiles, join_keys
from panelwright.operators import bins, cluster, compare, convergence, priority
from panelwright.plans import panels
from panelwright.plans.registry import query, rounded, whole, with_tables
from panelwright.schema import INDICATOR, literal_table
from panelwright.staging import settle

# ---- comparability ----

_PAIRS = [
    ("ship/share_r", "ship/share_a"),
    ("ship/share_r", "ship/revenue"),
    ("ship/share_r", "ship/quantity"),
    ("ship/share_r", "orders/finished"),
    ("ship/share_r", "supp/rich"),
    ("ship/share_a", "supp/rich"),
    ("ship/share_a", "ship/revenue"),
    ("ship/share_a", "ship/share_r"),
]


def _spec_panel(spark, sf):
    rich = panels.table(spark, sf, "supplier").select(
        F.when(F.col("s_acctbal") > 6000, "supp/rich").otherwise("supp/other").alias(INDICATOR),
        F.concat(F.lit("supp/"), F.col("s_suppkey").cast("string")).alias("place_id"),
    )
    keys = [INDICATOR, "place_id"]
    return (
        panels.supp_year(spark, sf).select(*keys)
        .unionByName(panels.cust_year(spark, sf).select(*keys))
        .unionByName(rich)
    )


def _specs(spark, sf):
    pairs = literal_table(spark, _PAIRS, "left_key string, right_key string")
    return compare.join_specs(
        pairs, panels.settings(spark), _spec_panel(spark, sf), panels.unit_families(spark),
        panels.dimension_aliases(spark),
    )


_SPEC = {
    "pairs": "SELECT * FROM (VALUES "
    + ", ".join(f"('{a}', '{b}')" for a, b in _PAIRS)
    + ") AS v(left_key, right_key)",
    "presence": """SELECT DISTINCT indicator_key, place_id FROM supp_year UNION ALL
        SELECT DISTINCT indicator_key, place_id FROM cust_year UNION ALL
        SELECT CASE WHEN s_acctbal > 6000 THEN 'supp/rich' ELSE 'supp/other' END, 'supp/' || s_suppkey FROM supplier""",
    "canon": "SELECT d.*, canonical FROM dims d LEFT JOIN aliases a ON d.dim = a.dim AND d.raw = a.alias",
    "meta": "SELECT s.*, family FROM settings s LEFT JOIN families ON unit = member",
    "both_dims": """SELECT left_key, right_key, string_agg(l.dim, ',' ORDER BY l.dim) AS names,
        string_agg(l.dim || '=' || CASE WHEN l.canonical = r.canonical THEN l.canonical ELSE '?' END, ',' ORDER BY l.dim) AS matches,
        string_agg('dimension_unmatched:' || l.dim, ',' ORDER BY l.dim) FILTER
            ((l.canonical IS DISTINCT FROM r.canonical OR l.canonical IS NULL) AND l.raw <> r.raw) AS unclear
        FROM pairs JOIN canon l ON left_key = l.indicator_key JOIN canon r ON right_key = r.indicator_key AND l.dim = r.dim
        GROUP BY ALL""",
    "sized": """SELECT p.*, (SELECT count(*) FROM presence WHERE indicator_key = left_key) AS n_left,
        (SELECT count(*) FROM presence WHERE indicator_key = right_key) AS n_right, coalesce(n, 0) AS n_shared
        FROM pairs p LEFT JOIN (SELECT left_key, right_key, count(*) AS n FROM pairs
        JOIN presence l ON left_key = l.indicator_key
        JOIN presence r ON right_key = r.indicator_key AND l.place_id = r.place_id GROUP BY ALL)
        USING (left_key, right_key)""",
    "judged": """SELECT s.*, n_shared / (n_left + n_right - n_shared) AS jaccard,
        CAST(greatest(least(l.temporal_end, r.temporal_end) - greatest(l.temporal_start, r.temporal_start) + 1, 0) AS BIGINT)
        AS shared_years, CASE WHEN l.unit = r.unit THEN 'same' WHEN l.family = r.family THEN 'same_family'
        WHEN l.family IS NOT NULL AND r.family IS NOT NULL THEN 'incomparable' ELSE 'unknown' END AS unit_relation,
        l.unit AS lu, r.unit AS ru FROM sized s JOIN meta l ON left_key = l.indicator_key
        JOIN meta r ON right_key = r.indicator_key""",
    "specs": """SELECT j.*, CASE WHEN n_shared = 0 OR shared_years = 0 THEN 'blocked'
        WHEN unit_relation IN ('same', 'same_family') THEN 'direct' ELSE 'axes_only' END AS comparability FROM judged j""",
    "latest": """SELECT indicator_key, place_id, max_by(value, (value >= 30, period)) AS value, max_by(date, (value >= 30, period)) AS date
        FROM supp_year GROUP BY ALL""",
    "points": """SELECT s.left_key, s.right_key, l.place_id, l.date AS left_date, r.date AS right_date,
        l.value AS left_value, r.value AS right_value, l.date = r.date AS same_year,
        CASE WHEN unit_relation IN ('same', 'same_family') THEN r.value - l.value END AS difference
        FROM specs s JOIN latest l ON left_key = l.indicator_key
        JOIN latest r ON right_key = r.indicator_key AND l.place_id = r.place_id WHERE comparability <> 'blocked'""",
}
_SPEC_TABLES = (
    "cust_year supp_wide supp_year settings dims families aliases pairs presence canon meta both_dims sized judged specs"
)


@query(
    "join_specs",
    with_tables(
        _SPEC_TABLES,
        """SELECT left_key, right_key, concat_ws(',', 'place_id', 'date', names) AS join_keys, coalesce(matches, '') AS shared_dimensions,
        n_left, n_right, n_shared, greatest(n_left, n_right) - n_shared AS n_only_one, round(jaccard, 6) AS jaccard,
        shared_years, unit_relation, comparability,
        concat_ws(',', CASE WHEN n_shared = 0 THEN 'no_places' END, CASE WHEN shared_years = 0 THEN 'no_years' END) AS blockers,
        concat_ws(',', unclear, CASE WHEN jaccard < 0.5 THEN 'low_place_overlap' END,
        CASE WHEN shared_years BETWEEN 1 AND 4 THEN 'few_shared_years' END,
        CASE WHEN unit_relation = 'unknown' THEN 'unknown_unit' END,
        CASE WHEN comparability = 'axes_only' AND unit_relation = 'incomparable'
             THEN 'different_units:' || lu || ':' || ru END) AS warnings,
        coalesce((SELECT string_agg(dim || '=' || raw, ',' ORDER BY dim) FROM dims d WHERE indicator_key = left_key
            AND dim NOT IN (SELECT dim FROM dims WHERE indicator_key = right_key)), '') AS left_only,
        coalesce((SELECT string_agg(dim || '=' || raw, ',' ORDER BY dim) FROM dims d WHERE indicator_key = right_key
            AND dim NOT IN (SELECT dim FROM dims WHERE indicator_key = left_key)), '') AS right_only
        FROM specs LEFT JOIN both_dims USING (left_key, right_key)""",
        _SPEC,
    ),
)
def join_specs(spark, sf):
    text = lambda m: F.array_join(
        F.transform(
            F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), e["value"])
        ),
        ",",
    )
    matches = F.transform(
        "shared_dimensions",
        lambda d: F.concat(d["dimension"], F.lit("="), F.coalesce(d["canonical"], F.lit("?"))),
    )
    return _specs(spark, sf).select(
        "left_key", "right_key", F.array_join("join_keys", ",").alias("join_keys"),
        F.array_join(matches, ",").alias("shared_dimensions"), "n_left", "n_right", "n_shared",
        "n_only_one", rounded("jaccard"), whole("shared_years"), "unit_relation", "comparability",
        F.array_join("blockers", ",").alias("blockers"),
        F.array_join("warnings", ",").alias("warnings"),
        text(F.col("left_only_dimensions")).alias("left_only"),
        text(F.col("right_only_dimensions")).alias("right_only"),
    )


def _points(spark, sf):
    # The last year with a value of 30 or more, else the last: so the two dates of a pair differ.
    order = F.struct(F.col("value") >= 30, "period")
    latest = (
        panels.supp_year(spark, sf)
        .groupBy(INDICATOR, "place_id")
        .agg(F.max_by("value", order).alias("value"), F.max_by("date", order).alias("date"))
    )
    return compare.compare_points(latest, _specs(spark, sf))


@query(
    "compare_points",
    with_tables(
        _SPEC_TABLES + " latest points",
        """SELECT left_key, right_key, place_id, left_date, right_date, round(left_value, 6) AS left_value,
        round(right_value, 6) AS right_value, same_year, round(difference, 6) AS difference FROM points""",
        _SPEC,
    ),
)
def compare_points(spark, sf):
    return _points(spark, sf).withColumns(
        {c: rounded(c) for c in ("left_value", "right_value", "difference")}
    )


@query(
    "cross_year_counts",
    with_tables(
        _SPEC_TABLES + " latest points",
        """SELECT left_key, right_key, count(*) AS n_places, count(*) FILTER (NOT same_year) AS n_cross_year
        FROM points GROUP BY ALL""",
        _SPEC,
    ),
)
def cross_year_counts(spark, sf):
    return compare.cross_year_counts(_points(spark, sf))


@query(
    "cross_source_agreement",
    with_tables(
        _SPEC_TABLES + " latest points worst",
        """SELECT p.left_key, p.right_key, count(*) FILTER (abs(left_value - right_value) <= 10) AS agree, count(*) AS total,
        count(*) FILTER (abs(left_value - right_value) <= 10) = count(*) AS passed,
        round(count(*) FILTER (abs(left_value - right_value) <= 10) / count(*), 6) AS share,
        coalesce(any_value(o), '') AS offenders FROM points p LEFT JOIN worst USING (left_key, right_key) GROUP BY ALL""",
        {
            **_SPEC,
            "worst": """SELECT left_key, right_key, string_agg(place_id || ' (' || printf('%.1f', gap) || ' pp)', ',' ORDER BY rn) AS o
            FROM (SELECT *, row_number() OVER (PARTITION BY left_key, right_key ORDER BY gap DESC, place_id) AS rn FROM (
            SELECT *, abs(left_value - right_value) AS gap FROM points) WHERE gap > 10) WHERE rn <= 8 GROUP BY ALL""",
        },
    ),
)
def cross_source_agreement(spark, sf):
    return compare.cross_source_agreement(_points(spark, sf)).withColumns(
        {"share": rounded("share"), "offenders": F.array_join("offenders", ",")}
    )


@query(
    "disagreements",
    with_tables(
        _SPEC_TABLES + " latest points",
        """SELECT left_key, right_key, n_disagreeing, place_id, round(left_value, 6) AS left_value,
        round(right_value, 6) AS right_value, left_date, right_date, same_year FROM (
        SELECT *, count(*) OVER (PARTITION BY left_key, right_key) AS n_disagreeing,
        row_number() OVER (PARTITION BY left_key, right_key ORDER BY abs(difference) DESC, place_id) AS rn
        FROM points WHERE abs(difference) > 10) WHERE rn = 1""",
        _SPEC,
    ),
)
def disagreements(spark, sf):
    return compare.disagreements(_points(spark, sf)).withColumns(
        {c: rounded(c) for c in ("left_value", "right_value")}
    )


@query(
    "unit_families",
    with_tables(
        "supp_wide supp_year settings families",
        """SELECT indicator_key, coalesce(family, '') AS unit_family, count(*) AS n_rows FROM supp_year
        JOIN settings USING (indicator_key) LEFT JOIN families ON unit = member GROUP BY ALL""",
    ),
)
def unit_families(spark, sf):
    units = panels.settings(spark).select(INDICATOR, "unit")
    rows = panels.supp_year(spark, sf).join(units, INDICATOR)
    rows = compare.with_unit_family(rows, panels.unit_families(spark))
    return rows.groupBy(INDICATOR, F.coalesce("unit_family", F.lit("")).alias("unit_family")).agg(
        F.count("*").alias("n_rows")
    )


@query(
    "canonical_dimensions",
    with_tables(
        "aliases raw",
        """SELECT r.dim, r.raw, coalesce(canonical, '') AS canonical,
        coalesce(label, CASE canonical WHEN 'clean_fuel' THEN 'Clean Fuel' WHEN 'urban' THEN 'Urban'
        WHEN 'male' THEN 'Male' END, '') AS dimension_label, count(*) AS n_parts
        FROM raw r LEFT JOIN aliases a ON r.dim = a.dim AND r.raw = a.alias GROUP BY ALL""",
        {
            "raw": """SELECT unnest(['URBANIZATION', 'SEX', 'COOK_FUEL']) AS dim,
            unnest([CASE p_size % 4 WHEN 0 THEN 'R' WHEN 1 THEN 'DOU_R' WHEN 2 THEN 'U' ELSE 'X' END,
                    CASE WHEN p_size % 2 = 0 THEN 'F' ELSE 'M' END, 'CLEAN']) AS raw FROM part"""
        },
    ),
)
def canonical_dimensions(spark, sf):
    size = F.col("p_size")
    values = F.create_map(
        F.lit("URBANIZATION"),
        F.when(size % 4 == 0, "R").when(size % 4 == 1, "DOU_R").when(size % 4 == 2, "U")
        .otherwise("X"),
        F.lit("SEX"), F.when(size % 2 == 0, "F").otherwise("M"),
        F.lit("COOK_FUEL"), F.lit("CLEAN"),
    )
    raw = panels.table(spark, sf, "part").select(F.explode(values).alias("dim", "raw"))
    raw = raw.groupBy("dim", "raw").agg(F.count("*").alias("n_parts"))
    df = compare.with_canonical_dimension(raw, panels.dimension_aliases(spark))
    blank = F.lit("")
    return df.withColumns(
        {
            "canonical": F.coalesce("canonical", blank),
            "dimension_label": F.coalesce("dimension_label", blank),
        }
    )


# ---- priority ----

from panelwright.plans.movement import _trend_tables  # noqa: E402


def _pct(column: str, keys: str = "indicator_key") -> str:
    return f"""(rank() OVER (PARTITION BY {keys} ORDER BY {column}) + (count(*) OVER (PARTITION BY {keys}, {column}) - 1) / 2.0::DOUBLE)
        / count(*) OVER (PARTITION BY {keys})"""


_PRIORITY = {
    **_trend_tables("rest"),
    "saturated": """SELECT indicator_key, place_id FROM (SELECT indicator_key, place_id, max_by(value, period) AS v
        FROM supp_year GROUP BY ALL) JOIN settings USING (indicator_key) WHERE v >= saturation_ceiling - 0.5""",
    "rest": """SELECT s.* FROM supp_year s ANTI JOIN saturated USING (indicator_key, place_id)""",
    "shared": """SELECT s.indicator_key, denominator, max(a.period) AS period FROM settings s
        JOIN (SELECT DISTINCT indicator_key, period FROM supp_year) a ON a.indicator_key = s.indicator_key
        JOIN (SELECT DISTINCT indicator_key, period FROM supp_year) b ON b.indicator_key = denominator AND a.period = b.period
        GROUP BY ALL""",
    "unserved": """SELECT a.indicator_key, a.place_id, a.period, a.value, p.value AS population,
        (100 - a.value) / 100 * p.value AS unserved_population FROM shared h
        JOIN supp_year a ON a.indicator_key = h.indicator_key AND a.period = h.period
        JOIN supp_year p ON p.indicator_key = h.denominator AND p.period = h.period AND p.place_id = a.place_id""",
    "ranked": f"""SELECT *, {_pct('unserved_population')} AS rank_unserved_pop, 1 - {_pct('slope0')} AS rank_stagnation
        FROM (SELECT u.*, coalesce(slope, 0) AS slope0 FROM unserved u LEFT JOIN trends USING (indicator_key, place_id))""",
    "scored": """SELECT *, (rank_unserved_pop * 2 + rank_stagnation * 0.5) / 2.5 AS priority_score FROM ranked""",
    "placed": """SELECT *, row_number() OVER (PARTITION BY indicator_key ORDER BY round(priority_score, 9) DESC, place_id) AS priority_rank,
        count(*) OVER (PARTITION BY indicator_key) AS priority_total FROM scored""",
}
_PRIORITY_TABLES = (
    "supp_wide supp_year settings saturated rest centred trends shared unserved ranked scored placed"
)
_WEIGHTS = {"unserved_pop": 2.0, "stagnation": 0.5}


def _priority(spark, sf, partitions=None):
    panel = panels.supp_year(spark, sf)
    return priority.compute_priority(
        panel.repartition(partitions) if partitions else panel, panels.settings(spark), weights=_WEIGHTS
    )


@query(
    "latest_shared_period",
    with_tables(
        "supp_wide supp_year settings shared",
        "SELECT indicator_key, denominator, CAST(period AS BIGINT) AS period FROM shared",
        _PRIORITY,
    ),
)
def latest_shared_period(spark, sf):
    df = priority.latest_shared_period(panels.supp_year(spark, sf), panels.settings(spark))
    return df.withColumn("period", whole("period"))


@query(
    "unserved_population",
    with_tables(
        "supp_wide supp_year",
        """SELECT a.indicator_key, a.place_id, CAST(a.period AS BIGINT) AS period, quantity AS population,
        round((100 - a.value) / 100 * quantity, 6) AS unserved_population FROM supp_year a
        JOIN supp_wide USING (place_id, period) WHERE a.indicator_key IN ('ship/share_r', 'ship/share_a')""",
    ),
)
def unserved_population(spark, sf):
    panel = panels.supp_year(spark, sf)
    access = panel.where(F.col(INDICATOR).isin("ship/share_r", "ship/share_a"))
    quantity = panel.where(F.col(INDICATOR) == "ship/quantity").select(
        F.explode(F.array(F.lit("ship/share_r"), F.lit("ship/share_a"))).alias(INDICATOR),
        "place_id",
        "period",
        F.col("value").alias("population"),
    )
    kept = priority.unserved_population(access, quantity).kept
    return kept.select(
        INDICATOR, "place_id", whole("period"), "population", rounded("unserved_population")
    )


_SCORED_SQL = """SELECT indicator_key, place_id, round(unserved_population, 6) AS unserved_population,
    round(slope0, 6) AS slope, round(rank_unserved_pop, 6) AS rank_unserved_pop,
    round(rank_stagnation, 6) AS rank_stagnation, round(priority_score, 6) AS priority_score"""


def _show_scored(df):
    return df.select(
        INDICATOR, "place_id", rounded("unserved_population"), rounded("slope"),
        rounded("rank_unserved_pop"), rounded("rank_stagnation"), rounded("priority_score"),
    )


@query(
    "priority_scores",
    with_tables(_PRIORITY_TABLES, _SCORED_SQL + " FROM scored", _PRIORITY),
)
def priority_scores(spark, sf):
    return _show_scored(_priority(spark, sf).scored)


@query(
    "priority_scores_distributed",
    with_tables(_PRIORITY_TABLES, _SCORED_SQL + " FROM scored", _PRIORITY),
)
def priority_scores_distributed(spark, sf):
    """The same rows from another partitioning."""
    return _show_scored(_priority(spark, sf, 16).scored)


@query(
    "priority_ranks",
    with_tables(
        _PRIORITY_TABLES,
        """SELECT indicator_key, place_id, priority_rank, priority_total,
        ' (priority rank #' || priority_rank || ' of ' || priority_total || ')' AS priority_suffix FROM placed""",
        _PRIORITY,
    ),
)
def priority_ranks(spark, sf):
    scored = _priority(spark, sf).scored.drop("priority_rank", "priority_total")
    # Scores equal up to the last bits count as ties, as they do in the SQL.
    placed = priority.priority_positions(
        scored.withColumn("priority_score", F.round("priority_score", 9))
    )
    return priority.with_priority_suffix(placed.select(INDICATOR, "place_id"), placed)


@query(
    "priority_totals",
    with_tables(
        _PRIORITY_TABLES,
        """SELECT indicator_key, round(sum(unserved_population), 4) AS total_unserved, count(*) AS n_places
        FROM unserved GROUP BY ALL""",
        _PRIORITY,
    ),
)
def priority_totals(spark, sf):
    return _priority(spark, sf).totals.select(INDICATOR, rounded("total_unserved", 4), "n_places")


@query(
    "priority_table",
    with_tables(
        _PRIORITY_TABLES,
        """SELECT indicator_key, place_id, s_name AS place_name, round(priority_score, 6) AS priority_score,
        round(rank_unserved_pop, 6) AS rank_unserved_pop, round(rank_stagnation, 6) AS rank_stagnation
        FROM scored LEFT JOIN supplier ON place_id = 'supp/' || s_suppkey""",
        _PRIORITY,
    ),
)
def priority_table(spark, sf):
    names = panels.table(spark, sf, "supplier").select(
        F.concat(F.lit("supp/"), F.col("s_suppkey").cast("string")).alias("place_id"),
        F.col("s_name").alias("place_name"),
    )
    df = priority.priority_table(_priority(spark, sf).scored, names)
    ranks = ("priority_score", "rank_unserved_pop", "rank_stagnation")
    return df.withColumns({c: rounded(c) for c in ranks})


# ---- ranks, quantiles, bins ----

_CELLS = """SELECT indicator_key, place_id, period, value FROM cust_year UNION ALL
    SELECT indicator_key, place_id, period, value FROM supp_year"""
_RANK_SQL = with_tables(
    "cust_year supp_wide supp_year cells",
    f"""SELECT indicator_key, place_id, CAST(period AS BIGINT) AS period, round(value, 6) AS value,
    round({_pct('value', 'indicator_key, period')}, 6) AS high_is_worse,
    round(1 - {_pct('value', 'indicator_key, period')}, 6) AS low_is_worse FROM cells""",
    {"cells": _CELLS},
)


def _cells(spark, sf):
    columns = [INDICATOR, "place_id", "period", "value"]
    return panels.cust_year(spark, sf).select(*columns).unionByName(
        panels.supp_year(spark, sf).select(*columns)
    )


_BOTH = {"high_is_worse": ("value", True), "low_is_worse": ("value", False)}


def _both_ranks(cells):
    keys = [INDICATOR, "period"]
    df = order_stats.percentile_ranks(cells, keys, _BOTH)
    return df.select(
        INDICATOR, "place_id", whole("period"), rounded("value"), rounded("high_is_worse"),
        rounded("low_is_worse"),
    )


@query("percentile_ranks", _RANK_SQL)
def percentile_ranks(spark, sf):
    return _both_ranks(settle(_cells(spark, sf)))


# A second half without an indicator key; infinite where the value is 0, null in one year.
_EDGE_CELLS = f"""{_CELLS} UNION ALL SELECT NULL, place_id, period, CASE WHEN period = 1995 THEN NULL
    WHEN value = 0 THEN CAST('-infinity' AS DOUBLE) WHEN value >= 99 THEN CAST('infinity' AS DOUBLE) ELSE value END FROM cust_year"""
_EDGE_RANK_SQL = with_tables(
    "cust_year supp_wide supp_year cells",
    f"""SELECT indicator_key, place_id, CAST(period AS BIGINT) AS period, value IS NULL AS missing,
    round(CASE WHEN value IS NOT NULL THEN {_pct('value', 'indicator_key, period')} END, 6) AS high_is_worse,
    round(CASE WHEN value IS NOT NULL THEN 1 - {_pct('value', 'indicator_key, period')} END, 6) AS low_is_worse FROM cells""",
    {"cells": _EDGE_CELLS},
)


def _edge_cells(spark, sf):
    value = (
        F.when(F.col("period") == 1995, None)
        .when(F.col("value") == 0, float("-inf"))
        .when(F.col("value") >= 99, float("inf"))
        .otherwise(F.col("value"))
    )
    odd = panels.cust_year(spark, sf).select(
        F.lit(None).cast("string").alias(INDICATOR), "place_id", "period", value.alias("value")
    )
    return _cells(spark, sf).unionByName(odd)


@query("percentile_ranks_distributed", _EDGE_RANK_SQL)
def percentile_ranks_distributed(spark, sf):
    """With a null key, infinite and null values, from another partitioning."""
    keys = [INDICATOR, "period"]
    df = order_stats.percentile_ranks(settle(_edge_cells(spark, sf).repartition(16)), keys, _BOTH)
    return df.select(
        INDICATOR, "place_id", whole("period"), F.col("value").isNull().alias("missing"),
        rounded("high_is_worse"), rounded("low_is_worse"),
    )


_QUANTILE_SQL = with_tables(
    "user_day",
    """SELECT indicator_key, round(min(value), 6) AS q0, round(quantile_cont(value, 0.1), 6) AS q10,
    round(median(value), 6) AS q50, round(quantile_cont(value, 0.975), 6) AS q97, round(max(value), 6) AS q100
    FROM user_day GROUP BY ALL""",
)
_PROBS = {"q0": 0.0, "q10": 0.1, "q50": 0.5, "q97": 0.975, "q100": 1.0}


@query("quantiles", _QUANTILE_SQL)
def quantiles(spark, sf):
    df = exact_quantiles(settle(panels.user_day(spark, sf)), [INDICATOR], "value", _PROBS)
    return df.select(INDICATOR, *[rounded(c) for c in _PROBS])


@query(
    "quantiles_distributed",
    with_tables(
        "cust_year supp_wide supp_year cells",
        """SELECT indicator_key, count(value) AS n, isinf(quantile_disc(value, 0)) AS q0_infinite,
        round(median(value), 6) AS q50, isinf(quantile_disc(value, 1)) AS q100_infinite FROM cells GROUP BY ALL""",
        {"cells": _EDGE_CELLS},
    ),
)
def quantiles_distributed(spark, sf):
    """With a null key, infinite and null values, from another partitioning."""
    cells = settle(_edge_cells(spark, sf).repartition(16))
    df = exact_quantiles(cells, [INDICATOR], "value", {"q0": 0.0, "q50": 0.5, "q100": 1.0})
    counts = cells.groupBy(INDICATOR).agg(F.count("value").alias("n"))
    infinite = [(F.abs(c) == float("inf")).alias(f"{c}_infinite") for c in ("q0", "q100")]
    return join_keys(df, counts, [INDICATOR]).select(INDICATOR, "n", rounded("q50"), *infinite)


_MEDIAN_SQL = with_tables(
    "supp_wide",
    """SELECT CAST(period AS BIGINT) AS period, round(min(share_r), 6) AS weighted_median FROM (SELECT *, sum(quantity) OVER (
    PARTITION BY period ORDER BY share_r) AS upto, sum(quantity) OVER (PARTITION BY period) AS total FROM supp_wide)
    WHERE upto >= total / 2 GROUP BY ALL""",
)


def _wide(spark, sf):
    names = ["ship/share_r", "ship/share_a", "ship/quantity"]
    wide = bins.to_wide(panels.supp_year(spark, sf), ["place_id", "period"], names)
    return wide.select(
        "place_id", "period",
        *[F.col(f"`{n}`").alias(n.removeprefix("ship/")) for n in names],
    )


@query("weighted_medians", _MEDIAN_SQL)
def weighted_medians(spark, sf):
    df = bins.weighted_median(
        settle(_wide(spark, sf)), ["period"], "share_r", "quantity", "weighted_median"
    )
    return df.select(whole("period"), rounded("weighted_median"))


@query(
    "weighted_medians_distributed",
    with_tables(
        "cust_year coarse",
        """SELECT place, period, min(v) AS weighted_median FROM (
          SELECT *, sum(w) OVER (PARTITION BY place, period ORDER BY v) AS upto, sum(w) OVER (PARTITION BY place, period) AS total FROM coarse)
        WHERE 2 * upto >= total GROUP BY ALL""",
        {
            "coarse": """SELECT CAST(CASE WHEN p > 0 THEN p END AS VARCHAR) AS place, CAST(period AS BIGINT) AS period, round(value / 25) * 25 AS v,
            CAST(0.1 * (1 + CAST(period AS BIGINT) % 3 + p) AS DECIMAL(38, 12)) AS w
            FROM (SELECT *, CAST(substr(place_id, 6) AS BIGINT) % 5 AS p FROM cust_year)"""
        },
    ),
)
def weighted_medians_distributed(spark, sf):
    """Weights of tenths, whose sums often stand on the half, and a null key."""
    p = F.substring_index("place_id", "/", -1).cast("bigint") % 5
    weight = (F.lit(0.1) * (1 + F.col("period").cast("bigint") % 3 + F.col("_p"))).alias("w")
    coarse = panels.cust_year(spark, sf).withColumn("_p", p).select(
        F.when(F.col("_p") > 0, F.col("_p")).cast("string").alias("place"), whole("period"), (F.round(F.col("value") / 25) * 25).alias("v"), weight
    )
    return bins.weighted_median(coarse.repartition(16), ["place", "period"], "v", "w", "weighted_median")


def _weighted(column: str) -> str:
    return f"""SELECT period, min({column}) AS ref FROM (SELECT *, sum(quantity) OVER (PARTITION BY period ORDER BY {column})
        AS upto, sum(quantity) OVER (PARTITION BY period) AS total FROM supp_wide) WHERE upto >= total / 2 GROUP BY ALL"""


@query(
    "quadrants",
    with_tables(
        "supp_wide mx my",
        """SELECT place_id, CAST(w.period AS BIGINT) AS period, round(mx.ref, 6) AS x_ref, round(my.ref, 6) AS y_ref,
        CASE WHEN share_r < mx.ref AND share_a < my.ref THEN 'headroom' WHEN share_r < mx.ref THEN 'low_x_high_y'
        WHEN share_a < my.ref THEN 'high_x_low_y' ELSE 'high_both' END AS quadrant
        FROM supp_wide w JOIN mx ON w.period = mx.period JOIN my ON w.period = my.period""",
        {"mx": _weighted("share_r"), "my": _weighted("share_a")},
    ),
)
def quadrants(spark, sf):
    points = settle(_wide(spark, sf))
    lines = bins.reference_lines(points, ["period"], "share_r", "share_a", "quantity")
    df = bins.with_quadrants(points, lines, ["period"], "share_r", "share_a")
    return df.select(
        "place_id", whole("period"), rounded("x_ref"), rounded("y_ref"), "quadrant"
    )


_BREAKS = {
    "vals": """SELECT indicator_key, place_id, value FROM supp_year UNION ALL
        SELECT indicator_key, place_id, value FROM nation_points UNION ALL
        SELECT 'nation/region', 'nation/' || n_nationkey, n_regionkey FROM nation UNION ALL
        SELECT 'nation/one', 'nation/' || n_nationkey, 1 FROM nation""",
    "d": "SELECT DISTINCT indicator_key, value FROM vals",
    "breaks": """SELECT indicator_key, count(*) AS n_distinct, CASE WHEN count(*) = 1 THEN [min(value), min(value)]
        WHEN count(*) <= 5 THEN list_sort(list(value))
        ELSE list_sort(list_distinct(quantile_cont(value, [0, 0.2, 0.4, 0.6, 0.8, 1]))) END AS breaks FROM d GROUP BY ALL""",
    "binned": """SELECT v.*, breaks, greatest(0, least(len(breaks) - 2, len(list_filter(breaks, lambda b: b < value)) - 1)) AS bin
        FROM vals v JOIN breaks USING (indicator_key)""",
}


def _values(spark, sf):
    columns = [INDICATOR, "place_id", "value"]
    nations = panels.table(spark, sf, "nation").select(
        F.concat(F.lit("nation/"), F.col("n_nationkey").cast("string")).alias("place_id"),
        F.col("n_regionkey").cast("double").alias("r"),
    )
    out = panels.supp_year(spark, sf).select(*columns)
    for part in (
        panels.nation_points(spark, sf),
        nations.select(F.lit("nation/region").alias(INDICATOR), "place_id", F.col("r").alias("value")),
        nations.select(F.lit("nation/one").alias(INDICATOR), "place_id", F.lit(1.0).alias("value")),
    ):
        out = out.unionByName(part.select(*columns))
    return settle(out)


@query(
    "quantile_breaks",
    with_tables(
        "supp_wide supp_year nation_points vals d breaks",
        """SELECT indicator_key, n_distinct, CAST(i AS BIGINT) AS position, round(breaks[i], 6) AS edge FROM (
        SELECT *, unnest(generate_series(1, len(breaks))) AS i FROM breaks)""",
        _BREAKS,
    ),
)
def quantile_breaks(spark, sf):
    df = bins.quantile_breaks(_values(spark, sf), [INDICATOR], "value")
    return df.select(INDICATOR, "n_distinct", F.posexplode("breaks").alias("p", "e")).select(
        INDICATOR, "n_distinct", (F.col("p") + 1).cast("bigint").alias("position"),
        F.round("e", 6).alias("edge"),
    )


@query(
    "binned_values",
    with_tables(
        "supp_wide supp_year nation_points vals d breaks binned",
        """SELECT indicator_key, place_id, round(value, 6) AS value, CAST(bin AS BIGINT) AS bin, printf('%.1f', breaks[bin + 1])
        || ' – ' || printf('%.1f', breaks[bin + 2]) AS label FROM binned""",
        _BREAKS,
    ),
)
def binned_values(spark, sf):
    values = _values(spark, sf)
    edges = bins.quantile_breaks(values, [INDICATOR], "value").select(INDICATOR, "breaks")
    df = values.join(edges, INDICATOR)
    df = df.withColumn("bin", bins.bin_index(F.col("value"), F.col("breaks")))
    return df.select(
        INDICATOR, "place_id", rounded("value"), whole("bin"),
        bins.bin_label(F.col("breaks"), F.col("bin")).alias("label"),
    )


@query(
    "shaded_geometry",
    with_tables(
        "supp_wide supp_year nation_points geometry vals d breaks binned",
        """SELECT g.place_id, value, CAST(coalesce(bin, -1) AS BIGINT) AS bin, CASE WHEN value IS NULL THEN 'no_data' ELSE
        printf('%.1f', breaks[bin + 1]) || ' – ' || printf('%.1f', breaks[bin + 2]) END AS bin_label
        FROM geometry g LEFT JOIN (SELECT * FROM binned WHERE indicator_key = 'supplier/balance') b
        ON g.place_id = b.place_id""",
        _BREAKS,
    ),
)
def shaded_geometry(spark, sf):
    points = panels.nation_points(spark, sf).where(F.col(INDICATOR) == "supplier/balance")
    edges = bins.quantile_breaks(points, [INDICATOR], "value")
    df = bins.shade_geometry(panels.geometry(spark, sf), points, edges)
    return df.withColumn("bin", F.coalesce("bin", F.lit(-1)).cast("bigint"))


@query(
    "shaded_indicators",
    with_tables(
        "supp_wide supp_year nation_points geometry vals d breaks binned",
        """SELECT k.indicator_key, g.place_id, round(value, 6) AS value, CAST(coalesce(bin, -1) AS BIGINT) AS bin, CASE WHEN value IS NULL
        THEN 'no_data' ELSE printf('%.1f', b.breaks[bin + 1]) || ' – ' || printf('%.1f', b.breaks[bin + 2]) END AS bin_label
        FROM geometry g CROSS JOIN (SELECT indicator_key FROM breaks) k
        LEFT JOIN binned b ON b.indicator_key = k.indicator_key AND b.place_id = g.place_id""",
        _BREAKS,
    ),
)
def shaded_indicators(spark, sf):
    values = _values(spark, sf)
    # supplier indicators have a value for each year, but none at a place that is drawn
    df = bins.shade_indicators(panels.geometry(spark, sf), values, bins.quantile_breaks(values, [INDICATOR], "value"))
    return df.withColumns({"value": rounded("value"), "bin": F.coalesce("bin", F.lit(-1)).cast("bigint")})


@query(
    "modal_dates",
    with_tables(
        "latest_point",
        """SELECT indicator_key, min_by(date, (-n, date)) AS modal_date FROM
        (SELECT indicator_key, date, count(*) AS n FROM latest_point GROUP BY ALL) GROUP BY ALL""",
    ),
)
def modal_dates(spark, sf):
    return bins.modal_date(panels.latest_point(spark, sf))


@query(
    "to_wide",
    with_tables(
        "supp_wide",
        """SELECT place_id, CAST(period AS BIGINT) AS period, round(share_r, 6) AS share_r,
        round(share_a, 6) AS share_a, quantity FROM supp_wide""",
    ),
)
def to_wide(spark, sf):
    return _wide(spark, sf).withColumns(
        {"period": whole("period"), "share_r": rounded("share_r"), "share_a": rounded("share_a")}
    )


# ---- groups of places ----

_FEATURES = ["ship/share_r", "ship/share_a", "ship/revenue"]


def _matrix(spark, sf):
    panel = panels.supp_year(spark, sf)
    latest = panel.groupBy(INDICATOR, "place_id").agg(
        F.max_by("value", "period").alias("value"), F.max("period").alias("period")
    )
    matrix = cluster.feature_matrix(latest, _FEATURES)
    return matrix.select(
        "place_id", *[F.col(f"`{n}`").alias(n.removeprefix("ship/")) for n in _FEATURES]
    )


_GROUPS = {
    "matrix": """SELECT place_id, max_by(share_r, period) AS share_r, max_by(share_a, period) AS share_a,
        max_by(revenue, period) AS revenue FROM supp_wide GROUP BY ALL""",
    "labelled": """SELECT m.*, n_regionkey AS cluster FROM matrix m JOIN supplier ON place_id = 'supp/' || s_suppkey
        JOIN nation ON s_nationkey = n_nationkey""",
    "centers": """SELECT cluster, avg(share_r) AS share_r, avg(share_a) AS share_a FROM labelled GROUP BY ALL""",
}


@query(
    "feature_matrix",
    with_tables(
        "supp_wide matrix",
        """SELECT place_id, round(share_r, 6) AS share_r, round(share_a, 6) AS share_a, round(revenue, 4) AS revenue
        FROM matrix""",
        _GROUPS,
    ),
)
def feature_matrix(spark, sf):
    return _matrix(spark, sf).select(
        "place_id", rounded("share_r"), rounded("share_a"), rounded("revenue", 4)
    )


_SHIP_CATALOG = [
    ("ship/revenue", ["trade", "money"], "Revenue", True, None),
    ("ship/share_r", ["trade"], "returned share", True, None),
    ("ship/share_a", ["trade", "quality"], "Accepted share", True, None),
    ("ship/quantity", ["trade"], "Amount", False, None),
    ("ship/base", ["trade"], "Base", True, "denominator"),
]


@query(
    "sibling_features",
    with_tables(
        "supp_wide matrix",
        """SELECT place_id, unnest(['ship/share_r', 'ship/share_a', 'ship/revenue']) AS indicator_key, CAST(unnest([0, 1, 2]) AS BIGINT)
        AS position, round(unnest([share_r, share_a, revenue]), 4) AS value FROM matrix""",
        _GROUPS,
    ),
)
def sibling_features(spark, sf):
    """The features of a target are chosen by its topics, then measured for every place."""
    kinds = "key string, topics array<string>, label string, enriched boolean, role string"
    known_keys = literal_table(spark, _SHIP_CATALOG, kinds)
    topics = literal_table(spark, [("quality", 0), ("trade", 1), ("money", 2)], "topic string, ordinal int")
    keys = cluster.feature_keys(known_keys, topics, "ship/share_r")
    panel = panels.supp_year(spark, sf)
    latest = panel.groupBy(INDICATOR, "place_id").agg(
        F.max_by("value", "period").alias("value"), F.max("period").alias("period")
    )
    matrix = cluster.feature_matrix(latest, keys)
    cells = [
        F.struct(F.lit(k).alias(INDICATOR), F.lit(i).cast("bigint").alias("position"), F.round(F.col(f"`{k}`"), 4).alias("value"))
        for i, k in enumerate(keys)
    ]
    return matrix.select("place_id", F.inline(F.array(*cells)))


def _labelled(spark, sf):
    regions = (
        panels.table(spark, sf, "supplier")
        .join(
            panels.table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")
        )
        .select(
            F.concat(F.lit("supp/"), F.col("s_suppkey").cast("string")).alias("place_id"),
            F.col("n_regionkey").alias("cluster"),
        )
    )
    return _matrix(spark, sf).join(regions, "place_id")


def _ranking(spark, sf):
    labelled = _labelled(spark, sf)
    centers = labelled.groupBy("cluster").agg(
        F.avg("share_r").alias("share_r"), F.avg("share_a").alias("share_a")
    )
    return labelled, cluster.rank_groups(centers, "share_r", "lower_is_better")


@query(
    "group_ranking",
    with_tables(
        "supp_wide matrix labelled centers",
        """SELECT 'share_r' AS indicator_key, CAST(w.cluster AS BIGINT) AS worst_cluster, round(w.share_r, 6) AS worst_value,
        CAST(b.cluster AS BIGINT) AS best_cluster, round(b.share_r, 6) AS best_value FROM
        (SELECT * FROM centers ORDER BY share_r DESC, cluster LIMIT 1) w,
        (SELECT * FROM centers ORDER BY share_r, cluster LIMIT 1) b""",
        _GROUPS,
    ),
)
def group_ranking(spark, sf):
    _, ranking = _ranking(spark, sf)
    return ranking.select(
        INDICATOR, whole("worst_cluster"), rounded("worst_value"), whole("best_cluster"),
        rounded("best_value"),
    )


@query(
    "group_members",
    with_tables(
        "supp_wide matrix labelled centers",
        """SELECT place_id, CAST(cluster AS BIGINT) AS cluster, (SELECT count(*) FROM labelled x WHERE x.cluster = l.cluster)
        AS n_places FROM labelled l WHERE cluster = (SELECT cluster FROM centers ORDER BY share_r DESC, cluster LIMIT 1)""",
        _GROUPS,
    ),
)
def group_members(spark, sf):
    labelled, ranking = _ranking(spark, sf)
    members = cluster.cluster_members(labelled, ranking)
    return members.join(cluster.cluster_sizes(labelled), "cluster").select(
        "place_id", whole("cluster"), "n_places"
    )


def _archetype_sql(columns: list[str], sizes: list[int], starts: int) -> str:
    """The whole search in SQL: starts, all rounds one after the other, silhouettes and choice.

    Rounds after the centres rest change nothing, so writing out all of them gives the same.
    """
    many = lambda text, sep=", ": sep.join(text.replace("#", c) for c in columns)
    steps = {
        "units": f"SELECT count(*) AS n, {many('pow(2.0, floor(log2(max(abs(#)))) + 1 - 40) AS u_#')} FROM matrix",
        "wholes": f"SELECT place_id, n, {many('CAST(round(# / u_#) AS HUGEINT) AS w_#')} FROM matrix, units",
        "stats": f"""SELECT {many('CAST(sum(w_#) AS DOUBLE) / max(n) AS m_#, sqrt(CAST(max(n) * sum(w_# * w_#) - sum(w_#) * sum(w_#) AS DOUBLE)) / max(n) AS sd_#')}
            FROM wholes""",
        "z": f"SELECT place_id, {many('CAST(floor((w_# - m_#) * (65536 / sd_#) + 0.5) AS BIGINT) AS #')} FROM wholes, stats",
        "f0": f"""SELECT s, 0 AS j, unnest(arg_min(struct_pack({many('# := #')}), (md5(place_id || '#' || s), place_id)))
            FROM z, range({starts}) AS t(s) GROUP BY s""",
    }
    square = many("(z.# - c.#) * (z.# - c.#)", " + ")
    for i in range(1, max(sizes)):
        steps[f"f{i}"] = f"""SELECT * FROM f{i - 1} UNION ALL
            SELECT s, {i}, unnest(arg_min(struct_pack({many('# := #')}), (-d, place_id))) FROM (
              SELECT s, place_id, {many('any_value(z.#) AS #')}, min({square}) AS d FROM z, f{i - 1} c GROUP BY s, place_id) GROUP BY s"""
    wanted = ", ".join(str(k) for k in sizes)
    steps["c0"] = f"SELECT k, s, j, {many('#')} FROM f{max(sizes) - 1}, unnest([{wanted}]) AS t(k) WHERE j < k"
    for i in range(cluster.MAX_ROUNDS + 1):
        steps[f"a{i}"] = f"SELECT k, s, place_id, min({square}) AS d, arg_min(j, ({square}, j)) AS j FROM z, c{i} c GROUP BY ALL"
        if i < cluster.MAX_ROUNDS:
            steps[f"c{i + 1}"] = f"""SELECT c.k, c.s, c.j, {many('coalesce(CAST(floor(avg(z.#) + 0.5) AS BIGINT), c.#) AS #')}
                FROM c{i} c LEFT JOIN a{i} a USING (k, s, j) LEFT JOIN z USING (place_id) GROUP BY c.k, c.s, c.j, {many('c.#')}"""
    last = cluster.MAX_ROUNDS
    dot = many("CAST(z.# AS BIGINT) * y.#", " + ")
    norm = many("z.# * z.#", " + ")
    steps |= {
        "cost": f"SELECT k, s, sum(d) AS cost FROM a{last} GROUP BY ALL",
        "own": f"SELECT a.* FROM a{last} a JOIN (SELECT k, arg_min(s, (cost, s)) AS s FROM cost GROUP BY k) USING (k, s)",
        "y": f"SELECT k, j, CAST(count(*) AS DOUBLE) AS n, CAST(sum({norm}) AS DOUBLE) AS q, {many('sum(z.#) AS #')} FROM own JOIN z USING (place_id) GROUP BY ALL",
        "t": f"""SELECT o.k, o.place_id, o.j = y.j AS mine, y.n, y.n * CAST({norm} AS DOUBLE) + y.q - 2 * CAST({dot} AS DOUBLE) AS t
            FROM own o JOIN z USING (place_id) JOIN y ON y.k = o.k""",
        "ab": """SELECT k, place_id, max(CASE WHEN mine THEN n END) AS n, max(CASE WHEN mine THEN t / greatest(n - 1, 1) END) AS a,
            min(CASE WHEN NOT mine THEN t / n END) AS b FROM t GROUP BY ALL""",
        "sil": """SELECT k, sum(CASE WHEN n > 1 AND greatest(a, b) > 0 THEN CAST(floor((b - a) / greatest(a, b) * 1e9 + 0.5) AS BIGINT) ELSE 0 END) AS score
            FROM ab GROUP BY k HAVING count(b) > 0""",
        "best": "SELECT arg_min(k, (-score, k)) AS k FROM sil",
        "numbered": f"""SELECT c.j, row_number() OVER (ORDER BY {many('c.#')}) - 1 AS cluster FROM (
            SELECT DISTINCT c.* FROM c{last} c JOIN own USING (k, s, j) JOIN best USING (k)) c""",
    }
    body = ",\n".join(f"{name} AS MATERIALIZED ({sql})" for name, sql in steps.items())
    start = with_tables("supp_wide matrix", "", _GROUPS)
    return f"""{start}, {body}
        SELECT CAST(cluster AS INTEGER) AS cluster, count(*) AS n_places, {many('round(avg(m.#), 4) AS #')}
        FROM own JOIN best USING (k) JOIN numbered USING (j) JOIN matrix m USING (place_id) GROUP BY cluster"""


_SHAPES = ["share_r", "share_a", "revenue"]


@query("archetypes", _archetype_sql(_SHAPES, [2, 3, 4, 5, 6], 10))
def archetypes(spark, sf):
    found = cluster.compute_archetypes(_matrix(spark, sf), _SHAPES)
    if found is None:
        return spark.createDataFrame([], "cluster int, n_places bigint, share_r double, share_a double, revenue double")
    rows = cluster.cluster_sizes(found.labels).join(found.centers, "cluster")
    return rows.select("cluster", "n_places", *[rounded(c, 4) for c in _SHAPES])


@query(
    "named_movers",
    with_tables(
        _PRIORITY_TABLES + " span ends middle behind movers",
        """SELECT m.indicator_key, list, position, m.place_id, coalesce(' (priority rank #' || priority_rank || ' of '
        || priority_total || ')', '') AS priority_suffix FROM movers m LEFT JOIN placed USING (indicator_key, place_id)""",
        {
            **_PRIORITY,
            "span": "SELECT indicator_key, min(period) AS b, max(period) AS e FROM supp_year GROUP BY ALL",
            "ends": """SELECT x.indicator_key, x.place_id, x.value AS base_value, y.value - x.value AS change FROM supp_year x
                JOIN span s ON x.indicator_key = s.indicator_key AND x.period = b
                JOIN supp_year y ON y.indicator_key = x.indicator_key AND y.place_id = x.place_id AND y.period = e""",
            "middle": """SELECT e.*, median(base_value) OVER (PARTITION BY indicator_key) AS m, polarity,
                CASE WHEN polarity = 'higher_is_better' THEN change ELSE -change END AS improvement
                FROM ends e JOIN settings USING (indicator_key)""",
            "behind": """SELECT * FROM middle
                WHERE (polarity = 'higher_is_better' AND base_value <= m) OR (polarity = 'lower_is_better' AND base_value >= m)""",
            "movers": """SELECT *, 'catching_up' AS list, row_number() OVER (PARTITION BY indicator_key
                ORDER BY improvement DESC, place_id) AS position FROM behind QUALIFY position <= 5
                UNION ALL SELECT *, 'falling_behind', row_number() OVER (PARTITION BY indicator_key
                ORDER BY improvement, place_id) AS position FROM behind QUALIFY position <= 5""",
        },
    ),
)
def named_movers(spark, sf):
    panel = panels.supp_year(spark, sf)
    indicators = panels.settings(spark)
    places, _ = convergence.endpoint_values(panel, convergence.series_endpoints(panel))
    movers, _ = convergence.convergence_movers(places, indicators)
    scored = _priority(spark, sf).scored.drop("priority_rank", "priority_total")
    placed = priority.priority_positions(
        scored.withColumn("priority_score", F.round("priority_score", 9))
    )
    named = priority.with_priority_suffix(movers, placed)
    return named.select(INDICATOR, "list", "position", "place_id", "priority_suffix")
