"""Comparability, priority, bins, wide tables and clusters."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelwright.operators import bins, cluster, compare, places, priority
from panelwright.schema import literal_table

META = (
    "indicator_key string, dimensions map<string,string>, unit string, unit_display string, "
    "temporal_start string, temporal_end string"
)
FAMILIES = [("Percent", "percent"), ("PT_POP", "percent"), ("W", "power")]
ALIASES = [
    ("URBANIZATION", "R", "rural", "Rural"),
    ("URBANIZATION", "DOU_R", "rural", "Rural"),
    ("URBANIZATION", "U", "urban", None),
]


def spec(spark, left, right, n_left=217, n_right=194, n_shared=194):
    """Verdict for two indicators given as (dimensions, unit, start, end)."""
    rows = [(k, d, u, u and u.lower(), s, e) for k, (d, u, s, e) in (("l", left), ("r", right))]
    seen = [("l", f"P{i}") for i in range(n_left)]
    seen += [("r", f"P{i + n_left - n_shared}") for i in range(n_right)]
    panel = spark.createDataFrame(seen + seen[:3], "indicator_key string, place_id string")
    return compare.join_specs(
        literal_table(spark, [("l", "r")], "left_key string, right_key string"),
        literal_table(spark, rows, META),
        panel,
        literal_table(spark, FAMILIES, "member string, family string"),
        literal_table(spark, ALIASES, "dim string, alias string, canonical string, label string"),
    ).first()


YEARS = ("2000", "2024")


def test_two_percentages_may_be_subtracted(spark):
    s = spec(spark, ({}, "Percent", *YEARS), ({}, "PT_POP", *YEARS))
    assert (s.n_left, s.n_right, s.n_shared, s.n_only_one) == (217, 194, 194, 23)
    assert round(s.jaccard, 3) == 0.894 and s.shared_years == 25
    assert (s.unit_relation, s.comparability) == ("same_family", "direct")
    assert s.blockers == [] and s.warnings == [] and s.join_keys == ["place_id", "date"]


def test_units_decide_what_is_allowed(spark):
    s = spec(spark, ({}, "Percent", *YEARS), ({}, "W", *YEARS))
    assert (s.unit_relation, s.comparability, s.warnings) == ("incomparable", "axes_only", ["different_units:percent:w"])
    s = spec(spark, ({}, "Percent", *YEARS), ({}, "Mystery", *YEARS))
    assert (s.unit_relation, s.comparability, s.warnings) == ("unknown", "axes_only", ["unknown_unit"])
    s = spec(spark, ({}, "Mystery", *YEARS), ({}, "Mystery", *YEARS))
    assert (s.unit_relation, s.comparability) == ("same", "direct")
    assert spec(spark, ({}, None, *YEARS), ({}, None, *YEARS)).unit_relation == "unknown"
    assert spec(spark, ({}, "", *YEARS), ({}, "", *YEARS)).unit_relation == "unknown"


def test_nothing_in_common_blocks(spark):
    s = spec(spark, ({}, "Percent", *YEARS), ({}, "Percent", *YEARS), 5, 4, 0)
    assert (s.comparability, s.blockers, s.jaccard) == ("blocked", ["no_places"], 0.0)
    s = spec(spark, ({}, "Percent", "2000", "2005"), ({}, "Percent", "2010", "2020"))
    assert (s.comparability, s.blockers, s.shared_years) == ("blocked", ["no_years"], 0)
    s = spec(spark, ({}, "Percent", "2000", "2005"), ({}, "Percent", "2010", "2020"), 0, 0, 0)
    assert s.blockers == ["no_places", "no_years"] and s.jaccard == 0.0


def test_small_overlaps_warn(spark):
    s = spec(spark, ({}, "Percent", "2000", "2012"), ({}, "Percent", "2010", "2020"), 10, 10, 3)
    assert s.warnings == ["low_place_overlap", "few_shared_years"] and s.shared_years == 3
    assert s.comparability == "direct"
    assert spec(spark, ({}, "Percent", None, "2012"), ({}, "Percent", *YEARS)).shared_years is None


def test_dimensions_meet_through_aliases(spark):
    s = spec(spark, ({"URBANIZATION": "R", "SEX": "F"}, "Percent", *YEARS), ({"URBANIZATION": "DOU_R", "AGE": "Y"}, "Percent", *YEARS))
    assert s.join_keys == ["place_id", "date", "URBANIZATION"] and s.warnings == []
    assert [tuple(d) for d in s.shared_dimensions] == [("URBANIZATION", "R", "DOU_R", "rural")]
    assert s.left_only_dimensions == {"SEX": "F"} and s.right_only_dimensions == {"AGE": "Y"}
    s = spec(spark, ({"URBANIZATION": "R"}, "Percent", *YEARS), ({"URBANIZATION": "U"}, "Percent", *YEARS))
    assert s.warnings == ["dimension_unmatched:URBANIZATION"]
    s = spec(spark, ({"Q": "same"}, "Percent", *YEARS), ({"Q": "same"}, "Percent", *YEARS))
    assert s.warnings == [] and s.shared_dimensions[0].canonical is None


def test_dimension_labels_fall_back_to_the_name(spark):
    raw = spark.createDataFrame([("URBANIZATION", "R"), ("URBANIZATION", "U"), ("URBANIZATION", "?")], "dim string, raw string")
    aliases = spark.createDataFrame(ALIASES + [("X", "y", "two_words", None)], "dim string, alias string, canonical string, label string")
    got = {r.raw: (r.canonical, r.dimension_label) for r in compare.with_canonical_dimension(raw, aliases).collect()}
    assert got == {"R": ("rural", "Rural"), "U": ("urban", "Urban"), "?": (None, None)}


def points(spark, rows, relation="same_family", verdict="direct"):
    latest = [("l", p, ld, lv) for p, ld, lv, _, _ in rows if ld] + [("r", p, rd, rv) for p, _, _, rd, rv in rows if rd]
    df = spark.createDataFrame(latest, "indicator_key string, place_id string, date string, value double")
    specs = literal_table(spark, [("l", "r", relation, verdict)], "left_key string, right_key string, unit_relation string, comparability string")
    return compare.compare_points(df, specs)


ROWS = [("A", "2020", 80.0, "2020", 82.0), ("B", "2020", 99.0, "2021", 99.5), ("C", "2020", 50.0, "2020", 75.0), ("D", "2020", 1.0, None, None)]


def test_points_keep_both_dates(spark):
    got = {r.place_id: r for r in points(spark, ROWS).collect()}
    assert set(got) == {"A", "B", "C"}
    assert got["C"].difference == 25.0 and got["A"].same_year and not got["B"].same_year
    c = compare.cross_year_counts(points(spark, ROWS)).first()
    assert (c.n_places, c.n_cross_year) == (3, 1)
    assert all(r.difference is None for r in points(spark, ROWS, "unknown", "axes_only").collect())
    assert points(spark, ROWS, "same", "blocked").count() == 0


def test_cross_source_agreement(spark):
    r = compare.cross_source_agreement(points(spark, ROWS)).first()
    assert (r.agree, r.total, r.passed, r.offenders) == (2, 3, False, ["C (25.0 pp)"])
    many = [(f"P{i:02d}", "2020", 0.0, "2020", 11.0 + i) for i in range(12)] + [("EDGE", "2020", 0.0, "2020", 10.0)]
    r = compare.cross_source_agreement(points(spark, many)).first()
    assert (r.agree, r.total, len(r.offenders), r.offenders[0]) == (1, 13, 8, "P11 (22.0 pp)")


def test_disagreements_are_strict_and_name_the_worst(spark):
    r = compare.disagreements(points(spark, ROWS + [("E", "2020", 0.0, "2020", 10.0)])).first()
    assert (r.n_disagreeing, r.place_id, r.left_value, r.right_value) == (1, "C", 50.0, 75.0)
    assert compare.disagreements(points(spark, ROWS[:2])).count() == 0
    nan = points(spark, ROWS[:2] + [("N", "2020", math.nan, "2020", 1.0)])
    assert compare.disagreements(nan).count() == 0
    assert compare.cross_source_agreement(nan).first().total == 2


# ---- priority ----


def test_unserved_population(spark, panel):
    access = panel({"A": [80], "B": [50], "N": [None], "ONLY": [10]})
    pop = spark.createDataFrame([("x", "A", 2000, 1e6), ("x", "B", 2000, 2e6), ("x", "N", 2000, 5.0), ("x", "Q", 2000, 1.0)], "indicator_key string, place_id string, period int, population double")
    out = priority.unserved_population(access, pop)
    assert {r.place_id: round(r.unserved_population, 3) for r in out.kept.collect()} == {"A": 200_000, "B": 1_000_000}
    assert (out.report.first().n_before, out.report.first().n_dropped) == (3, 1)
    assert [r.place_id for r in out.places.collect()] == ["N"]


def test_priority_score_is_a_weighted_sum_of_ranks(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"place_id": [f"P{i}" for i in range(40)], "unserved": rng.integers(0, 9, 40).astype(float), "slope": rng.normal(size=40).round(1)})
    pdf.insert(0, "indicator_key", "x")
    parts = {"a": ("unserved", True), "b": ("slope", False)}
    for weights, wa, wb in ((None, 1, 1), ({"a": 3.0, "b": 0.5}, 3, 0.5), ({"a": 2.0}, 2, 1)):
        scored = priority.priority_score(spark.createDataFrame(pdf), parts, weights)
        got = scored.toPandas().set_index("place_id").loc[pdf.place_id]
        ra = pdf.unserved.rank(pct=True).to_numpy()
        rb = 1 - pdf.slope.rank(pct=True).to_numpy()
        np.testing.assert_allclose(got.rank_a, ra)
        np.testing.assert_allclose(got.priority_score, (wa * ra + wb * rb) / (wa + wb))
    placed = priority.priority_positions(scored).toPandas().sort_values("priority_rank")
    assert list(placed.priority_rank) == list(range(1, 41)) and set(placed.priority_total) == {40}
    assert placed.priority_score.is_monotonic_decreasing


def test_missing_component_gives_no_score_and_comes_last(spark):
    df = spark.createDataFrame([("x", "A", 1.0), ("x", "B", None), ("x", "C", 2.0)], "indicator_key string, place_id string, v double")
    scored = priority.priority_score(df, {"v": ("v", True)})
    assert {r.place_id: r.priority_score for r in scored.collect()} == {"A": 0.5, "B": None, "C": 1.0}
    assert [r.place_id for r in priority.priority_positions(scored).orderBy("priority_rank").collect()] == ["C", "A", "B"]


def test_priority_pipeline(spark, panel, indicators):
    access = panel({"A": [10, 11, 12], "B": [50, 60, 70], "FULL": [99, 99.5, 100], "NEW": {2002: 20}})
    pop = panel({"A": [100, 100, 100], "B": [100, 100, 100], "FULL": [100, 100, 100], "NEW": [5, 5, 5]}, indicator="pop")
    both = access.unionByName(pop).unionByName(panel({"A": {2005: 13}}))
    meta = indicators(ceiling=100.0, denominator="pop")
    out = priority.compute_priority(both, meta)
    assert [(r.indicator_key, r.period) for r in out.periods.collect()] == [("x", 2002)]
    rows = {r.place_id: r for r in out.scored.collect()}
    assert set(rows) == {"A", "B", "FULL", "NEW"}
    assert rows["NEW"].slope == 0.0 and rows["FULL"].slope == 0.0 and rows["B"].slope == pytest.approx(10)
    assert [r.place_id for r in out.saturated.collect()] == ["FULL"]
    assert out.totals.first().total_unserved == pytest.approx(88 + 30 + 0 + 4)
    table = priority.priority_table(out.scored, spark.createDataFrame([("A", "Aland"), ("B", "")], "place_id string, place_name string"))
    assert table.columns == ["indicator_key", "place_id", "place_name", "priority_score", "rank_unserved_pop", "rank_stagnation"]
    suffix = {r.place_id: r.priority_suffix for r in priority.with_priority_suffix(panel({"A": [1], "Q": [1]}), out.scored).collect()}
    assert suffix["Q"] == "" and suffix["A"].startswith(" (priority rank #") and suffix["A"].endswith(" of 4)")
    assert priority.compute_priority(both, indicators()).scored.count() == 0


def test_default_focus(panel, indicators):
    df = panel({f"P{i}": [i] for i in range(8)} | {"N": [None]})
    order = lambda polarity: [r.place_id for r in priority.default_focus(df, indicators(polarity), 3).orderBy("position").collect()]
    assert order("higher_is_better") == ["P0", "P1", "P2"]
    assert order("lower_is_better") == ["P7", "P6", "P5"]
    assert order("neutral") == ["P7", "P6", "P5"]


# ---- bins ----


@pytest.mark.parametrize("values, weights, want", [([1, 2, 3, 4], [0.1, 0.2, 0.2, 0.1], 2), ([10, 20, 90], [1, 1, 100], 90), ([10, 20, 30], [1, 1, 1], 20), ([5], [2], 5), ([3, 1, 2, 2], [1, 4, 1, 2], 1)])
def test_weighted_median(spark, values, weights, want):
    df = spark.createDataFrame([("k", float(v), float(w)) for v, w in zip(values, weights)], "k string, v double, w double")
    assert bins.weighted_median(df, ["k"], "v", "w", "m").first().m == want


def test_reference_lines_and_quadrants(spark):
    rows = [("k", 1.0, 1.0, 1.0), ("k", 2.0, 9.0, 1.0), ("k", 9.0, 2.0, 10.0), ("z", 1.0, 5.0, 0.0), ("z", 3.0, 7.0, 0.0)]
    df = spark.createDataFrame(rows, "k string, x double, y double, w double")
    lines = bins.reference_lines(df, ["k"], "x", "y", "w")
    assert {r.k: (r.x_ref, r.y_ref) for r in lines.collect()} == {"k": (9.0, 2.0), "z": (2.0, 6.0)}
    got = {(r.k, r.x): r.quadrant for r in bins.with_quadrants(df, lines, ["k"], "x", "y").collect()}
    assert got == {("k", 1.0): "headroom", ("k", 2.0): "low_x_high_y", ("k", 9.0): "high_both", ("z", 1.0): "headroom", ("z", 3.0): "high_both"}


def breaks_by_hand(values, n=5):
    u = sorted(set(values))
    if len(u) <= 1:
        return [u[0], u[0]]
    if len(u) <= n:
        return u
    return sorted(set(np.quantile(u, [i / n for i in range(n + 1)])))


def test_breaks_and_bins(spark):
    rng = np.random.default_rng(4)
    series = {"one": [7.0] * 5, "few": [1.0, 2.0, 2.0, 3.0], "five": [1.0, 2, 3, 4, 5], "full": [100.0] * 60 + list(rng.uniform(5, 95, 60)), "many": list(rng.normal(size=80))}
    rows = [(k, float(v)) for k, vs in series.items() for v in vs] + [("many", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    edges = bins.quantile_breaks(df, ["k"], "v")
    got = {r.k: r.breaks for r in edges.collect()}
    for k, vs in series.items():
        np.testing.assert_allclose(got[k], breaks_by_hand(vs))
    binned = df.join(edges, "k").withColumn("b", bins.bin_index(F.col("v"), F.col("breaks"))).collect()
    for r in binned:
        if r.v is None:
            assert r.b is None
            continue
        want = next((i for i in range(len(r.breaks) - 1) if r.v <= r.breaks[i + 1]), len(r.breaks) - 2)
        assert r.b == want


def test_bin_label_and_values_outside(spark):
    df = spark.createDataFrame([(v,) for v in (-1.0, 0.0, 65.1, 70.0, 500.0)], "v double")
    edges = F.array(*[F.lit(x) for x in (0.0, 65.1, 88.7)])
    df = df.withColumn("b", bins.bin_index(F.col("v"), edges))
    assert [r.b for r in df.collect()] == [0, 0, 0, 1, 1]
    labels = [r.t for r in df.select(bins.bin_label(edges, F.col("b"), F.lit("%")).alias("t")).collect()]
    assert labels[0] == "0.0 % – 65.1 %" and labels[-1] == "65.1 % – 88.7 %"


def test_geometry_without_data_is_a_category(spark, panel):
    shapes = spark.createDataFrame([("A",), ("B",), ("ATA",)], "place_id string")
    values = panel({"A": [1], "B": [3]})
    got = {r.place_id: (r.bin, r.bin_label) for r in bins.shade_geometry(shapes, values, bins.quantile_breaks(values, ["indicator_key"], "value")).collect()}
    assert got == {"A": (0, "1.0 – 3.0"), "B": (0, "1.0 – 3.0"), "ATA": (None, "no_data")}


def test_all_indicators_are_shaded_in_one_pass(spark, panel):
    shapes = spark.createDataFrame([("A",), ("B",), ("ATA",), ("A",)], "place_id string")
    values = panel({"A": [1], "B": [3]}).unionByName(panel({"B": [7], "X": [2]}, indicator="y")).unionByName(panel({"A": [5]}, indicator="z"))
    edges = bins.quantile_breaks(values.where("indicator_key <> 'z'"), ["indicator_key"], "value")
    got = sorted((r.indicator_key, r.place_id, r.value, r.bin, r.bin_label) for r in bins.shade_indicators(shapes, values, edges).collect())
    one, two = sorted({r[0] for r in got})
    assert got == [
        (one, "A", 1.0, 0, "1.0 – 3.0"), (one, "ATA", None, None, "no_data"), (one, "B", 3.0, 0, "1.0 – 3.0"),
        (two, "A", None, None, "no_data"), (two, "ATA", None, None, "no_data"), (two, "B", 7.0, 0, "2.0 – 7.0"),
    ]
    assert bins.shade_indicators(shapes, values, edges.limit(0)).count() == 0


def test_modal_date_takes_the_earliest_on_a_tie(panel):
    df = panel({"A": [1, 1], "B": [1, 1], "C": {2002: 1}})
    assert bins.modal_date(df).first().modal_date == "2000"


def test_wide_tables(panel):
    df = panel({"A": {2000: None, 2001: 5, 2002: 6}}).unionByName(panel({"A": [9], "B": [8]}, indicator="y"))
    got = {r.place_id: (r.x, r.y) for r in bins.to_wide(df, ["place_id"], ["x", "y"]).collect()}
    assert got == {"A": (5.0, 9.0), "B": (None, 8.0)}
    assert [r.place_id for r in cluster.feature_matrix(df, ["x", "y"]).collect()] == ["A"]


# ---- places ----


def test_places(spark, panel):
    names = spark.createDataFrame([("A", "Aland"), ("B", "")], "place_id string, place_name string")
    named = places.with_display_name(places.attach_place_names(panel({"A": [1], "B": [1], "C": [1]}), names))
    assert {r.place_id: (r.place_name, r.display_name) for r in named.collect()} == {"A": ("Aland", "Aland"), "B": (None, "B"), "C": (None, "C")}
    edges = spark.createDataFrame([("africa", "A", 0), ("asia", "A", 1), ("asia", "B", 1)], "parent string, place_id string, ordinal int")
    parents = places.place_parents(edges)
    assert {r.place_id: r.parent for r in parents.collect()} == {"A": "asia", "B": "asia"}
    all_parents = spark.createDataFrame([("africa",), ("asia",), ("oceania",)], "parent string")
    assert {r.parent: r.n_places for r in places.parent_counts(all_parents, edges).collect()} == {"africa": 1, "asia": 2, "oceania": 0}
    df = panel({"A": [1], "C": [1]})
    assert places.filter_region(df, parents, None).count() == 2
    assert [r.place_id for r in places.filter_region(df, parents, "asia").collect()] == ["A"]
    assert places.select_places(df, ["C"]).count() == 1 and places.select_places(df, names).count() == 1
    sized = places.attach_population(df, spark.createDataFrame([("A", 5.0)], "place_id string, population double"))
    assert sized.kept.count() == 1 and [r.place_id for r in sized.places.collect()] == ["C"]


# ---- clusters ----

BLOBS = [(f"P{i}", float(i % 6) / 10, float(i % 5) / 10) for i in range(6)] + [(f"Q{i}", 10 + i / 10, 10 - i / 10) for i in range(6)]


def test_two_blobs_are_two_groups(spark):
    df = spark.createDataFrame(BLOBS + [("N", None, 1.0)], "place_id string, x double, y double")
    found = cluster.compute_archetypes(df, ["x", "y"], k_range=range(2, 4), n_init=2)
    assert found.k_used == 2 and set(found.silhouettes) == {2, 3}
    labels = {r.place_id: r.cluster for r in found.labels.collect()}
    assert "N" not in labels and len({labels[f"P{i}"] for i in range(6)}) == 1
    assert labels["P0"] != labels["Q0"]
    assert sorted(round(r.x, 2) for r in found.centers.collect()) == [0.25, 10.25]
    fixed = cluster.compute_archetypes(df, ["x", "y"], k=3, n_init=1)
    assert fixed.k_used == 3
    assert cluster.compute_archetypes(df.limit(1), ["x", "y"]) is None


def test_groups_depend_on_the_rows_alone(spark):
    """Neither the order of rows nor their partitions, with or without runtime re-planning."""
    rng = random.Random(4)
    rows = [(f"P{i:03d}", rng.gauss(i % 3 * 2, 1), rng.random() * 1e-9, rng.gauss(0, 1e8)) for i in range(90)]
    rows += [(f"T{i}", 1.0, 0.0, -5.0) for i in range(9)] + [("flat", None, 1.0, 1.0)]
    seen = set()
    before = spark.conf.get("spark.sql.adaptive.enabled")
    try:
        for adaptive, parts in ((True, 1), (False, 3), (False, 13)):
            spark.conf.set("spark.sql.adaptive.enabled", adaptive)
            df = spark.createDataFrame(rng.sample(rows, len(rows)), "place_id string, x double, y double, `z 1` double")
            found = cluster.compute_archetypes(df.repartition(parts), ["x", "y", "z 1"], n_init=3)
            labels = tuple(sorted((r.place_id, r.cluster) for r in found.labels.collect()))
            seen.add((labels, tuple(found.silhouettes.items()), found.k_used))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert len(seen) == 1
    labels, scores, used = next(iter(seen))
    assert dict(scores)[used] == max(dict(scores).values()) and len({c for p, c in labels if p[0] == "T"}) == 1


def test_a_column_without_spread_and_more_groups_than_values(spark):
    df = spark.createDataFrame([(f"P{i}", float(i // 5), 7.0) for i in range(10)], "place_id string, x double, y double")
    found = cluster.compute_archetypes(df, ["x", "y"], n_init=2)
    assert found.k_used == 2 and found.silhouettes[2] == 1.0
    assert sorted((r.cluster, r.n_places) for r in cluster.cluster_sizes(found.labels).collect()) == [(0, 5), (1, 5)]


def test_group_ranking(spark):
    centers = spark.createDataFrame([(0, 5.0), (1, 2.0), (2, 5.0)], "cluster int, x double")
    r = cluster.rank_groups(centers, "x", "higher_is_better").first()
    assert (r.worst_cluster, r.worst_value, r.best_cluster, r.best_value) == (1, 2.0, 0, 5.0)
    r = cluster.rank_groups(centers, "x", "lower_is_better")
    assert (r.first().worst_cluster, r.first().best_cluster) == (0, 1)
    labels = spark.createDataFrame([("A", 0), ("B", 1), ("C", 0)], "place_id string, cluster int")
    assert sorted(x.place_id for x in cluster.cluster_members(labels, r).collect()) == ["A", "C"]
    assert {x.cluster: x.n_places for x in cluster.cluster_sizes(labels).collect()} == {0: 2, 1: 1}
    assert cluster.rank_groups(centers, "x", "neutral") is None
    assert cluster.rank_groups(centers, "other", "higher_is_better") is None


def test_feature_keys_are_enriched_siblings(spark):
    rows = [("t", ["e"], "Target", True, None), ("b", ["e"], "beta", True, None), ("a", ["e", "w"], "Alpha", True, None), ("c", ["e"], "Cee", True, None), ("n", ["e"], "Aaa", False, None), ("d", ["e"], "Aab", True, "denominator"), ("w", ["w"], "Aac", True, None)]
    cat = spark.createDataFrame(rows, "key string, topics array<string>, label string, enriched boolean, role string")
    topics = spark.createDataFrame([("e", 0), ("w", 1)], "topic string, ordinal int")
    assert cluster.feature_keys(cat, topics, "t") == ["t", "a", "b"]
    assert cluster.feature_keys(cat, topics, "missing") == []


def test_groupings_whose_centres_rest_take_no_further_part(spark, monkeypatch):
    from panelwright.operators import cluster

    cells = [(f"p{i}", [x]) for i, x in enumerate([0, 1, 2, 3, 100, 101, 102, 103, 104, 300])]
    points = spark.createDataFrame(cells, "place_id string, _z array<bigint>")
    sizes, literal = [], cluster._literal
    monkeypatch.setattr(cluster, "_literal", lambda groups: sizes.append(len(groups)) or literal(groups))
    slow, fast = [(0,), (1,), (2,)], [(2,), (102,), (300,)]
    together = cluster._rounds(points, [slow, fast])
    assert sizes[0] == 2 and sizes[-1] == 1
    assert together == cluster._rounds(points, [slow]) + cluster._rounds(points, [fast])
