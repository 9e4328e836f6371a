"""Where the figures came from, and which independent derivations of them agree.

A check is (indicator_key, check, agree, total, passed, offenders, note).
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.functions.ids import id_agency, id_code, id_dimensions
from panelwright.functions.order_stats import top_per_key
from panelwright.operators.coverage import audit_join, unmatched_places
from panelwright.schema import INDICATOR, LINEAGE_STEPS
from panelwright.staging import settle

SHOWN = 8


def _check(df: DataFrame, name: str, agree, total, passed: Column, offenders=None, note=None):
    none = F.array().cast("array<string>")
    return df.select(
        INDICATOR,
        F.lit(name).alias("check"),
        F.col(agree).cast("bigint").alias("agree") if isinstance(agree, str)
        else agree.cast("bigint").alias("agree"),
        total.cast("bigint").alias("total"),
        passed.alias("passed"),
        F.coalesce(offenders, none).alias("offenders") if offenders is not None
        else none.alias("offenders"),
        (note if note is not None else F.lit(None).cast("string")).alias("note"),
    )


def _first_offenders(rows: DataFrame, column: str, n: int | None = SHOWN) -> DataFrame:
    """Up to n offenders per indicator, in order."""
    first = top_per_key(rows, [INDICATOR], [F.asc(column)], n) if n else rows
    return first.groupBy(INDICATOR).agg(F.array_sort(F.collect_list(column)).alias("_off"))


class Facts(NamedTuple):
    """Row counts per indicator, and per indicator with facet, date and served unit."""

    rows: DataFrame
    facets: DataFrame
    dates: DataFrame
    units: DataFrame


def lineage_facts(latest: DataFrame) -> Facts:
    """All counts the checks need from a single read, as one aggregation over grouping sets.

    The counts are written: a few rows per indicator, read by every check.
    """
    unknown = F.lit("?")
    rows = latest.select(
        INDICATOR,
        F.coalesce("facet_id", unknown).alias("facet"),
        F.coalesce("date", unknown).alias("date"),
        F.when(F.col("facet_id").isNotNull(), F.col("unit")).alias("unit"),
    )
    key, columns = F.col(INDICATOR), ["facet", "date", "unit"]
    sets = [[key], *[[key, F.col(c)] for c in columns]]
    counts = rows.groupingSets(sets, key, *[F.col(c) for c in columns]).agg(
        F.count("*").alias("_n"),
        *[F.grouping(c).cast("int").alias(f"_no_{c}") for c in columns],
    )
    counts = settle(counts)
    of = lambda c: counts.where(F.col(f"_no_{c}") == 0).select(INDICATOR, c, "_n")
    alone = F.lit(True)
    for c in columns:
        alone = alone & (F.col(f"_no_{c}") == 1)
    return Facts(
        counts.where(alone).select(INDICATOR, "_n"),
        of("facet"),
        of("date"),
        of("unit").where(F.col("unit").isNotNull()),
    )


def coverage_check(facts: Facts, indicators: DataFrame) -> DataFrame:
    """Recorded number of places against the rows there are now; none without a record."""
    rows = (
        indicators.where(F.col("place_coverage") > 0)
        .select(INDICATOR, "place_coverage")
        .join(facts.rows, INDICATOR, "left")
        .fillna(0, subset=["_n"])
    )
    recorded, now = F.col("place_coverage"), F.col("_n")
    note = F.when(recorded != now, F.format_string("%d → %d", recorded, now))
    return _check(
        rows, "catalog_coverage", F.least(recorded, now), F.greatest(recorded, now),
        recorded == now, note=note,
    )


def unit_check(facts: Facts, indicators: DataFrame) -> DataFrame:
    """Units actually served against the catalog's unit."""
    wanted = indicators.where(F.col("unit") != "").select(INDICATOR, F.col("unit").alias("_unit"))
    served = facts.units.join(wanted, INDICATOR)
    off = _first_offenders(served.where(F.col("unit") != F.col("_unit")), "unit", None)
    counts = served.groupBy(INDICATOR).agg(
        F.count("*").alias("_served"),
        F.count(F.when(F.col("unit") == F.col("_unit"), 1)).alias("_agree"),
    )
    rows = wanted.join(counts, INDICATOR, "left").join(off, INDICATOR, "left")
    rows = rows.fillna(0, subset=["_served", "_agree"])
    return _check(
        rows, "unit_drift", "_agree", F.greatest("_served", F.lit(1)),
        F.col("_off").isNull(), F.col("_off"),
    )


def facet_check(facts: Facts) -> DataFrame:
    """Share of values from the dominant facet.

    Offenders are all facets but the alphabetically first; ``non_dominant_facets`` lists the
    others properly. The list holds distinct facets, of which an indicator has a few however
    many rows it has.
    """
    rows = facts.facets.groupBy(INDICATOR).agg(
        F.max("_n").alias("_max"),
        F.sum("_n").alias("_total"),
        F.array_sort(F.collect_list("facet")).alias("_facets"),
    )
    rest = F.slice("_facets", 2, F.greatest(F.size("_facets") - 1, F.lit(0)))
    return _check(
        rows, "single_facet", "_max", F.col("_total"), F.size("_facets") <= 1, rest
    )


def non_dominant_facets(latest: DataFrame) -> DataFrame:
    """Rows of the facets that are not an indicator's most frequent one."""
    counts = latest.groupBy(INDICATOR, F.coalesce("facet_id", F.lit("?")).alias("facet")).agg(
        F.count("*").alias("n_values")
    )
    top = counts.groupBy(INDICATOR).agg(
        F.min_by("facet", F.struct(-F.col("n_values"), F.col("facet"))).alias("dominant_facet")
    )
    return counts.join(top, INDICATOR).where(F.col("facet") != F.col("dominant_facet"))


def year_check(facts: Facts) -> DataFrame:
    """Share of places on the most frequent date; offenders have a different count from it."""
    rows = facts.dates.groupBy(INDICATOR).agg(
        F.max("_n").alias("_max"), F.sum("_n").alias("_total"), F.count("*").alias("_dates")
    )
    others = facts.dates.join(rows, INDICATOR).where(F.col("_n") != F.col("_max"))
    off = _first_offenders(others.select(INDICATOR, "date"), "date")
    return _check(
        rows.join(off, INDICATOR, "left"), "same_year", "_max", F.col("_total"),
        F.col("_dates") <= 1, F.col("_off"),
    )


def geometry_check(latest: DataFrame, geometry: DataFrame) -> DataFrame:
    off = _first_offenders(unmatched_places(latest, geometry), "place_id")
    rows = audit_join(latest, geometry).join(off, INDICATOR, "left")
    return _check(
        rows, "map_join", "n_matched", F.col("n_observations"), F.col("is_clean"), F.col("_off")
    )


def cross_source_as_check(agreement: DataFrame) -> DataFrame:
    """The cross-source result, filed under the left indicator of its pair."""
    rows = agreement.withColumn(INDICATOR, F.col("left_key"))
    return _check(
        rows, "cross_source", "agree", F.col("total"), F.col("passed"), F.col("offenders")
    )


def lineage_checks(
    latest: DataFrame,
    indicators: DataFrame,
    geometry: DataFrame,
    cross_source: DataFrame | None = None,
) -> DataFrame:
    facts = lineage_facts(latest)
    out = geometry_check(latest, geometry)
    for part in (
        coverage_check(facts, indicators),
        unit_check(facts, indicators),
        facet_check(facts),
        year_check(facts),
    ):
        out = out.unionByName(part)
    if cross_source is not None:
        out = out.unionByName(cross_source_as_check(cross_source))
    return out.withColumn(
        "share", F.coalesce(F.col("agree") / F.nullif("total", F.lit(0)), F.lit(0.0))
    )


def failing_checks(checks: DataFrame) -> DataFrame:
    return checks.groupBy(INDICATOR).agg(
        F.count(F.when(~F.col("passed"), 1)).alias("n_failing"), F.count("*").alias("n_checks")
    )


def source_rows(latest: DataFrame, indicators: DataFrame) -> DataFrame:
    """One row per provenance that served a value, with what it provides.

    The list of labels is limited by the number of indicators, not by the data. The agency is
    the one of the last indicator, as later entries replace earlier ones.
    """
    served = latest.where(F.col("facet_id").isNotNull()).select(
        INDICATOR, "facet_id", "provenance_id", "provenance_url", "observation_period"
    ).distinct()
    meta = indicators.select(
        INDICATOR,
        "label",
        F.col("source_agency").alias("_agency"),
        F.col("provenance_id").alias("_provenance"),
        F.col("provenance_url").alias("_url"),
    )
    rows = served.join(meta, INDICATOR).select(
        F.coalesce("provenance_id", "_provenance", F.lit("unknown")).alias("id"),
        F.upper(F.coalesce("_agency", F.lit("—"))).alias("agency"),
        "label",
        INDICATOR,
        "facet_id",
        F.coalesce("observation_period", F.lit("—")).alias("period"),
        F.coalesce("provenance_url", "_url").alias("url"),
    )
    order = F.struct(INDICATOR, "facet_id")
    listed = F.array_sort(F.collect_list(F.struct(INDICATOR, "facet_id", "label")))
    last = F.max_by(F.struct("agency", "period", "url"), order)
    return rows.groupBy("id").agg(
        F.array_join(F.transform(listed, lambda r: r["label"]), ", ").alias("provides"),
        last.alias("_last"),
    ).select("id", "_last.agency", "provides", "_last.period", "_last.url")


def selection_rows(indicators: DataFrame) -> DataFrame:
    """The variable id of each indicator taken apart into (parameter, value) rows."""
    v = F.col("variable_id")
    pair = lambda name, value: F.struct(F.lit(name).alias("parameter"), value.alias("value"))
    fixed = F.array(
        pair("variable", v),
        pair("agency", F.coalesce(id_agency(v), F.lit("—"))),
        pair("code", id_code(v)),
        pair("parentEntity", F.lit("Earth")),
        pair("childType", F.lit("Country")),
    )
    dims = F.transform(
        F.array_sort(F.map_entries(id_dimensions(v))),
        lambda e: F.struct(
            F.concat(F.lit("dimension: "), e["key"]).alias("parameter"), e["value"].alias("value")
        ),
    )
    return indicators.select(INDICATOR, F.posexplode(F.concat(fixed, dims))).select(
        INDICATOR, F.col("pos").alias("position"), "col.parameter", "col.value"
    )


def transformation_steps(indicators: DataFrame, compared: DataFrame | None = None) -> DataFrame:
    """The steps applied to each indicator, in order. ``compared`` lists indicator_keys."""
    if compared is None:
        rows = indicators.withColumn("_compared", F.lit(False))
    else:
        flag = compared.select(INDICATOR).distinct().withColumn("_compared", F.lit(True))
        rows = indicators.join(flag, INDICATOR, "left")
    steps = F.array(
        *[F.lit(s) for s in LINEAGE_STEPS],
        F.when(F.col("saturation_ceiling").isNotNull(), F.lit("transform.saturation")),
        F.when(F.col("denominator") != "", F.lit("transform.denominator")),
        F.when(F.col("_compared"), F.lit("transform.merge")),
    )
    return rows.select(INDICATOR, F.posexplode(F.array_compact(steps)).alias("position", "step"))


def lineage_counts(latest: DataFrame, geometry: DataFrame, indicators: DataFrame) -> DataFrame:
    """Rows, geometries, indicators and distinct provenances behind the figures."""
    places = latest.agg(F.count("*").alias("places"))
    return places.select(
        "places",
        geometry.agg(F.countDistinct("place_id")).scalar().alias("geometries"),
        indicators.agg(F.count("*")).scalar().alias("indicators"),
        indicators.agg(F.countDistinct(F.nullif("provenance_id", F.lit("")))).scalar().alias(
            "sources"
        ),
    )


class Lineage(NamedTuple):
    sources: DataFrame
    selection: DataFrame
    fields: DataFrame
    transformations: DataFrame
    counts: DataFrame
    checks: DataFrame


def build_lineage(
    latest: DataFrame,
    indicators: DataFrame,
    geometry: DataFrame,
    compared: DataFrame | None = None,
    cross_source: DataFrame | None = None,
) -> Lineage:
    return Lineage(
        source_rows(latest, indicators),
        selection_rows(indicators),
        indicators.select(
            INDICATOR, F.col("label").alias("shown"), F.col("variable_id").alias("field")
        ),
        transformation_steps(indicators, compared),
        lineage_counts(latest, geometry, indicators),
        lineage_checks(latest, indicators, geometry, cross_source),
    )


def citations(indicators: DataFrame, as_of: DataFrame | None = None) -> DataFrame:
    """One citation line per indicator; absent parts are left out.

    ``as_of`` has (indicator_key, as_of).
    """
    rows = indicators.select(
        INDICATOR,
        "label",
        "provenance_id",
        "provenance_url",
        F.coalesce(F.nullif("unit_display", F.lit("")), "unit").alias("unit_shown"),
    )
    if as_of is None:
        rows = rows.withColumn("as_of", F.lit(None).cast("string"))
    else:
        rows = rows.join(as_of.select(INDICATOR, "as_of"), INDICATOR, "left")
    part = lambda lead, c: F.when(F.col(c) != "", F.concat(F.lit(lead), F.col(c)))
    line = F.concat_ws(
        " ", "label", part("· ", "provenance_url"), part("· unit: ", "unit_shown"),
        part("· ", "as_of"),
    )
    return rows.withColumn("citation", line)


def uncited(panel: DataFrame, cited: DataFrame) -> DataFrame:
    """Indicators with rows but no citation: has to be empty before anything is shown."""
    return panel.select(INDICATOR).distinct().join(cited.select(INDICATOR), INDICATOR, "left_anti")


def require_citations(panel: DataFrame, cited: DataFrame) -> DataFrame:
    """The panel; running it fails at the first row of an indicator without a citation."""
    flag = cited.select(INDICATOR).distinct().withColumn("_cited", F.lit(True))
    joined = panel.join(flag, INDICATOR, "left")
    guard = F.assert_true(
        F.coalesce("_cited", F.lit(False)), F.lit("an indicator has no citation attached")
    )
    return joined.where(guard.isNull()).drop("_cited")
