"""May two indicators be compared, and where do they disagree.

Pairs are given as a table (left_key, right_key), so the work follows the pairs asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.functions.order_stats import top_per_key
from panelwright.functions.text import fixed
from panelwright.operators.change import known
from panelwright.schema import DISAGREEMENT_POINTS, INDICATOR, SERIES
from panelwright.staging import settle

MIN_JACCARD = 0.5
MIN_SHARED_YEARS = 5
SHOWN_OFFENDERS = 8
PAIR = ["left_key", "right_key"]


def pairs_with(indicators: DataFrame, focus: str) -> DataFrame:
    """Every other indicator paired with the one in focus."""
    return indicators.where(F.col(INDICATOR) != focus).select(
        F.lit(focus).alias("left_key"), F.col(INDICATOR).alias("right_key")
    )


def with_unit_family(df: DataFrame, families: DataFrame, unit: str = "unit") -> DataFrame:
    """Adds ``unit_family`` from (member, family); null for an unknown or missing unit."""
    lookup = families.select(F.col("member").alias("_member"), F.col("family").alias("unit_family"))
    return df.join(lookup, F.col(unit) == F.col("_member"), "left").drop("_member")


def with_canonical_dimension(df: DataFrame, aliases: DataFrame) -> DataFrame:
    """Adds ``canonical`` and ``dimension_label`` to (dim, raw) rows; null when unknown.

    ``aliases`` has (dim, alias, canonical, label). Without a label the canonical name is
    spelled out.
    """
    lookup = aliases.select("dim", F.col("alias").alias("raw"), "canonical", "label")
    label = F.coalesce("label", F.initcap(F.replace("canonical", F.lit("_"), F.lit(" "))))
    return (
        df.join(lookup, ["dim", "raw"], "left").withColumn("dimension_label", label).drop("label")
    )


def _canonical_maps(indicators: DataFrame, aliases: DataFrame) -> DataFrame:
    dims = indicators.select(INDICATOR, F.explode("dimensions").alias("dim", "raw"))
    known = with_canonical_dimension(dims, aliases).where(F.col("canonical").isNotNull())
    return known.groupBy(INDICATOR).agg(
        F.map_from_entries(F.collect_list(F.struct("dim", "canonical"))).alias("canonical")
    )


def shared_years(ls: Column, le: Column, rs: Column, re: Column) -> Column:
    years = F.least(le.cast("int"), re.cast("int")) - F.greatest(ls.cast("int"), rs.cast("int")) + 1
    complete = (
        (F.length(ls) > 0) & (F.length(le) > 0) & (F.length(rs) > 0) & (F.length(re) > 0)
    )
    return F.when(complete, F.greatest(years, F.lit(0)))


def join_specs(
    pairs: DataFrame,
    indicators: DataFrame,
    panel: DataFrame,
    families: DataFrame,
    aliases: DataFrame,
) -> DataFrame:
    """The full compatibility verdict of every requested pair.

    ``indicators`` gives dimensions, unit, unit_display, temporal_start and temporal_end.
    Places are counted from the panel: distinct (indicator, place) pairs, joined on the place
    within each requested pair. The verdicts, a row per pair, are written. Warnings and blockers are stable ids; a view turns them into
    sentences.
    """
    meta = with_unit_family(indicators, families).join(
        _canonical_maps(indicators, aliases), INDICATOR, "left"
    )
    empty = F.create_map().cast("map<string,string>")
    meta = meta.select(
        INDICATOR,
        F.coalesce("dimensions", empty).alias("dims"),
        F.coalesce("canonical", empty).alias("canon"),
        "unit",
        F.coalesce("unit_display", "unit").alias("shown_unit"),
        "unit_family",
        F.col("temporal_start").alias("start"),
        F.col("temporal_end").alias("end"),
    )

    def side(prefix: str) -> DataFrame:
        fields = [c for c in meta.columns if c != INDICATOR]
        return meta.select(
            F.col(INDICATOR).alias(f"{prefix}_key"),
            *[F.col(c).alias(f"{prefix[0]}_{c}") for c in fields],
        )

    # Read four times below, and far smaller than the panel.
    present = settle(panel.select(*SERIES).distinct())
    counts = present.groupBy(INDICATOR).agg(F.count("*").alias("_n"))
    left = present.select(F.col(INDICATOR).alias("left_key"), "place_id")
    right = present.select(F.col(INDICATOR).alias("right_key"), "place_id")
    shared = (
        pairs.join(left, "left_key")
        .join(right, ["right_key", "place_id"])
        .groupBy(*PAIR)
        .agg(F.count("*").alias("n_shared"))
    )
    out = (
        pairs.join(side("left"), "left_key")
        .join(side("right"), "right_key")
        .join(counts.select(F.col(INDICATOR).alias("left_key"), F.col("_n").alias("n_left")),
              "left_key", "left")
        .join(counts.select(F.col(INDICATOR).alias("right_key"), F.col("_n").alias("n_right")),
              "right_key", "left")
        .join(shared, PAIR, "left")
        .fillna(0, subset=["n_left", "n_right", "n_shared"])
    )

    l_dims, r_dims, l_canon, r_canon = (F.col(c) for c in ("l_dims", "r_dims", "l_canon", "r_canon"))
    names = F.array_sort(F.array_intersect(F.map_keys(l_dims), F.map_keys(r_dims)))

    def agreed(name: Column) -> Column:
        lc, rc = F.try_element_at(l_canon, name), F.try_element_at(r_canon, name)
        return F.when(lc == rc, lc)

    unclear = F.filter(
        names,
        lambda n: agreed(n).isNull()
        & (F.try_element_at(l_dims, n) != F.try_element_at(r_dims, n)),
    )
    n_shared, union = F.col("n_shared"), F.col("n_left") + F.col("n_right") - F.col("n_shared")
    jaccard = F.coalesce(n_shared / F.nullif(union, F.lit(0)), F.lit(0.0))
    years = shared_years(F.col("l_start"), F.col("l_end"), F.col("r_start"), F.col("r_end"))
    relation = (
        F.when((F.col("l_unit") != "") & (F.col("l_unit") == F.col("r_unit")), "same")
        .when(F.col("l_unit_family") == F.col("r_unit_family"), "same_family")
        .when(
            F.col("l_unit_family").isNotNull() & F.col("r_unit_family").isNotNull(), "incomparable"
        )
        .otherwise("unknown")
    )
    blockers = F.array_compact(
        F.array(F.when(n_shared == 0, F.lit("no_places")), F.when(years == 0, F.lit("no_years")))
    )
    out = out.select(
        "*",
        names.alias("_names"),
        jaccard.alias("jaccard"),
        years.alias("shared_years"),
        relation.alias("unit_relation"),
        blockers.alias("blockers"),
    )
    verdict = (
        F.when(F.size("blockers") > 0, "blocked")
        .when(F.col("unit_relation").isin("same", "same_family"), "direct")
        .otherwise("axes_only")
    )
    few = (F.col("shared_years") > 0) & (F.col("shared_years") < MIN_SHARED_YEARS)
    out = out.withColumn("comparability", verdict)
    warnings = F.concat(
        F.transform(unclear, lambda n: F.concat(F.lit("dimension_unmatched:"), n)),
        F.array_compact(
            F.array(
                F.when(F.col("jaccard") < MIN_JACCARD, F.lit("low_place_overlap")),
                F.when(few, F.lit("few_shared_years")),
                F.when(F.col("unit_relation") == "unknown", F.lit("unknown_unit")),
                F.when(
                    (F.col("comparability") == "axes_only")
                    & (F.col("unit_relation") == "incomparable"),
                    F.concat_ws(
                        ":", F.lit("different_units"), F.col("l_shown_unit"), F.col("r_shown_unit")
                    ),
                ),
            )
        ),
    )
    matches = F.transform(
        F.col("_names"),
        lambda n: F.struct(
            n.alias("dimension"),
            F.try_element_at(l_dims, n).alias("left_value"),
            F.try_element_at(r_dims, n).alias("right_value"),
            agreed(n).alias("canonical"),
        ),
    )
    specs = out.select(
        *PAIR,
        F.concat(F.array(F.lit("place_id"), F.lit("date")), F.col("_names")).alias("join_keys"),
        matches.alias("shared_dimensions"),
        F.map_filter(l_dims, lambda k, v: ~F.map_contains_key(r_dims, k)).alias(
            "left_only_dimensions"
        ),
        F.map_filter(r_dims, lambda k, v: ~F.map_contains_key(l_dims, k)).alias(
            "right_only_dimensions"
        ),
        "n_left",
        "n_right",
        "n_shared",
        (F.greatest("n_left", "n_right") - n_shared).alias("n_only_one"),
        "jaccard",
        "shared_years",
        "unit_relation",
        "comparability",
        "blockers",
        warnings.alias("warnings"),
    )
    return settle(specs)


def compare_points(latest: DataFrame, specs: DataFrame) -> DataFrame:
    """Latest values of both indicators side by side, for pairs that are not blocked.

    Both dates stay; the difference exists only where the units allow arithmetic.
    """
    def side(name: str) -> DataFrame:
        return latest.select(
            F.col(INDICATOR).alias(f"{name}_key"),
            "place_id",
            F.col("date").alias(f"{name}_date"),
            F.col("value").alias(f"{name}_value"),
        )

    allowed = specs.where(F.col("comparability") != "blocked").select(*PAIR, "unit_relation")
    arithmetic = F.col("unit_relation").isin("same", "same_family")
    return (
        allowed.join(side("left"), "left_key")
        .join(side("right"), ["right_key", "place_id"])
        .select(
            *PAIR,
            "place_id",
            "left_date",
            "right_date",
            "left_value",
            "right_value",
            F.col("left_date").eqNullSafe(F.col("right_date")).alias("same_year"),
            F.when(arithmetic, F.col("right_value") - F.col("left_value")).alias("difference"),
        )
    )


def cross_year_counts(points: DataFrame) -> DataFrame:
    return points.groupBy(*PAIR).agg(
        F.count("*").alias("n_places"),
        F.count(F.when(~F.col("same_year"), 1)).alias("n_cross_year"),
    )


def cross_source_agreement(
    points: DataFrame, threshold: float = DISAGREEMENT_POINTS
) -> DataFrame:
    """Shared places within ``threshold`` of each other, and the worst of the others."""
    rows = points.where(known("left_value") & known("right_value"))
    rows = rows.withColumn("_gap", F.abs(F.col("left_value") - F.col("right_value")))
    worst = top_per_key(
        rows.where(F.col("_gap") > threshold),
        PAIR,
        [F.desc("_gap"), F.asc("place_id")],
        SHOWN_OFFENDERS,
        "_rank",
    )
    text = F.struct("_rank", F.concat("place_id", F.lit(" ("), fixed("_gap", 1), F.lit(" pp)")).alias("text"))
    worst = worst.groupBy(*PAIR).agg(
        F.array_sort(F.collect_list(text)).getField("text").alias("offenders")
    )
    counts = rows.groupBy(*PAIR).agg(
        F.count(F.when(F.col("_gap") <= threshold, 1)).alias("agree"), F.count("*").alias("total")
    )
    return counts.join(worst, PAIR, "left").select(
        *PAIR,
        "agree",
        "total",
        (F.col("agree") == F.col("total")).alias("passed"),
        (F.col("agree") / F.col("total")).alias("share"),
        F.coalesce("offenders", F.array().cast("array<string>")).alias("offenders"),
    )


def disagreements(points: DataFrame, threshold: float = DISAGREEMENT_POINTS) -> DataFrame:
    """How many places differ by more than ``threshold``, and the worst of them."""
    size = F.abs("difference")
    row = F.struct(
        "place_id", "left_value", "right_value", "left_date", "right_date", "same_year"
    )
    return (
        points.where(known("difference") & (size > threshold))
        .groupBy(*PAIR)
        .agg(
            F.count("*").alias("n_disagreeing"),
            F.min_by(row, F.struct(-size, F.col("place_id"))).alias("_worst"),
        )
        .select(*PAIR, "n_disagreeing", "_worst.*")
    )
