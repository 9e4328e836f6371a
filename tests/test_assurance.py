"""Coverage, quality checks, lineage and citations."""

import json

import pytest
from pyspark.sql import functions as F

from panelwright.operators import coverage, lineage, quality

LATEST = "indicator_key string, place_id string, date string, value double, facet_id string, unit string"
META = (
    "indicator_key string, label string, source string, upstream_source string, unit string, "
    "value_min double, value_max double, place_coverage bigint"
)


def latest(spark, rows):
    full = [("x", f"country/{p}", d, v, f, u) for p, d, v, f, u in rows]
    return spark.createDataFrame(full, LATEST)


def meta(spark, unit="Percent", low=0.0, high=100.0, places=None, key="x"):
    from panelwright.schema import literal_table

    return literal_table(spark, [(key, "Label", "src", None, unit, low, high, places)], META)


# ---- coverage ----


def test_coverage_of_217_places_with_25_holes(panel, indicators):
    series = {f"P{i:03d}": {y: 1 for y in range(2000, 2025)} for i in range(216)}
    series["LAST"] = {1999: 1}
    df = panel(series).where("place_id <> 'LAST' or period = 1999")
    r = coverage.coverage_report(df, indicators()).first()
    assert (r.n_places_total, r.n_place_years_expected, r.n_missing_cells) == (217, 5425, 24)
    r = coverage.coverage_report(df, indicators(), clip=True).first()
    assert r.n_missing_cells == 25 and r.missing_share == pytest.approx(25 / 5425)


def test_coverage_counts_null_values_and_can_turn_negative(panel, indicators):
    df = panel({"A": {1998: 1, 1999: 1, 2000: None}})
    r = coverage.coverage_report(df, indicators(start="2000", end="2000")).first()
    assert (r.n_place_years_expected, r.n_place_years_observed, r.n_missing_cells) == (1, 3, -2)
    r = coverage.coverage_report(df, indicators(start="2005", end="2000")).first()
    assert (r.n_place_years_expected, r.missing_share) == (0, 0.0)


def test_grid_and_missing_cells_agree(panel, indicators):
    df = panel({"A": {2000: 1, 2002: 1, 2009: 1}, "B": {2001: 1}})
    only = indicators(start="2000", end="2002")
    grid = coverage.coverage_grid(df, only)
    got = {(r.place_id, r.period): r.observed for r in grid.collect()}
    assert got == {("A", 2000): 1, ("A", 2001): 0, ("A", 2002): 1, ("B", 2000): 0, ("B", 2001): 1, ("B", 2002): 0}
    holes = {(r.place_id, r.period) for r in coverage.missing_cells(df, only).collect()}
    assert holes == {k for k, v in got.items() if v == 0}
    wide = {r.place_id: (r["2000"], r["2001"], r["2002"]) for r in coverage.coverage_grid_wide(grid, [2000, 2001, 2002]).collect()}
    assert wide == {"A": (1, 0, 1), "B": (0, 1, 0)}


def test_missing_cells_are_written_as_csv(spark, panel, indicators, tmp_path):
    holes = coverage.missing_cells(panel({"A": {2000: 1}}), indicators(start="2000", end="2002"))
    coverage.write_missing_cells(holes, str(tmp_path / "gaps"))
    back = spark.read.option("header", True).csv(str(tmp_path / "gaps"))
    assert sorted((r.place_id, r.period) for r in back.collect()) == [("A", "2001"), ("A", "2002")]


def test_stalest_places_first(panel):
    df = panel({f"P{i:02d}": {2000 + i % 4: 1} for i in range(14)})
    rows = coverage.stalest_places(df).orderBy("position").collect()
    assert len(rows) == 10
    assert [(r.latest_period, r.place_id) for r in rows] == sorted((r.latest_period, r.place_id) for r in rows)
    assert rows[0].place_id == "P00"


def test_join_audit(spark, panel):
    shapes = spark.createDataFrame([("A",), ("B",), ("ATA",)], "place_id string")
    df = panel({"A": [1], "B": [2], "Z": [3]})
    r = coverage.audit_join(df, shapes).first()
    assert (r.n_observations, r.n_geometries, r.n_matched, r.is_clean) == (3, 3, 2, False)
    assert [r.place_id for r in coverage.unmatched_places(df, shapes).collect()] == ["Z"]
    assert [r.place_id for r in coverage.unmatched_geometry(df, shapes).collect()] == ["ATA"]
    assert coverage.audit_join(df.where("place_id <> 'Z'"), shapes).first().is_clean


def test_asymmetry(spark):
    left = spark.createDataFrame([("A",), ("B",)], "place_id string")
    right = spark.createDataFrame([("B",), ("C",), ("D",)], "place_id string")
    rows = {(r.place_id, r.side) for r in coverage.coverage_asymmetry(left, right).collect()}
    assert rows == {("A", "left_only"), ("C", "right_only"), ("D", "right_only")}
    f = coverage.coverage_asymmetry_finding(left, right).first()
    assert (f.level, f.code, json.loads(f.evidence)) == ("info", "COVERAGE_ASYMMETRY", {"n_left_only": 1, "n_right_only": 2})


# ---- dropping rows ----


def test_drop_missing_reports_everything(spark):
    df = spark.createDataFrame([("A", 1.0), ("B", None), ("C", float("nan")), ("B", 2.0), (None, None)], "place_id string, v double")
    out = quality.drop_missing(df, ["v"], "no value for 100% sure")
    r = out.report.first()
    assert (r.n_before, r.n_after, r.n_dropped) == (5, 2, 3)
    assert r.message == "Excluded 3 rows: no value for 100% sure (n=3 of 5)"
    assert sorted(x.place_id for x in out.places.collect()) == ["B", "C"]
    assert out.kept.count() == 2
    assert quality.drop_missing(df.select("v"), ["v"], "x").places.count() == 0


def test_filter_report(spark):
    r = quality.filter_report(spark.range(10), F.col("id") < 4, "small ids").first()
    assert (r.n_before, r.n_after, r.code) == (10, 4, "FILTER_APPLIED")
    assert r.message == "small ids: 10 → 4 rows (6 dropped)"


def test_duplicate_cells(panel):
    df = panel({"A": [1, 2]})
    assert quality.duplicate_cells(df).count() == 0
    assert quality.duplicate_cells(df.unionByName(df.where("period = 2000"))).first().code == "DUPLICATE_CELL"


# ---- pull checks ----


def codes(spark, rows, **options):
    found = quality.pull_findings(latest(spark, rows), meta(spark, **options)).collect()
    return {f.code: f for f in found}


CLEAN = [("RWA", "2023", 50.0, "f", "Percent"), ("KEN", "2023", 60.0, "f", "Percent")]


def test_clean_pull_has_no_findings(spark):
    assert codes(spark, CLEAN) == {}


def test_each_check_fires_alone(spark):
    assert set(codes(spark, [])) == {"EMPTY_VARIABLE"}
    bad = codes(spark, CLEAN + [("rwa", "2023", 1.0, "f", "Percent"), ("AB", "2023", 1.0, "f", "Percent")])
    assert set(bad) == {"MALFORMED_PLACE_ID"}
    assert json.loads(bad["MALFORMED_PLACE_ID"].evidence) == {"examples": ["country/AB", "country/rwa"]}
    drift = codes(spark, CLEAN + [("UGA", "2023", 1.0, "f", "Index")])
    assert set(drift) == {"UNIT_DRIFT"} and drift["UNIT_DRIFT"].level == "error"
    assert json.loads(drift["UNIT_DRIFT"].evidence) == {"catalog_unit": "Percent", "fetched_unit": "Index"}
    out = codes(spark, CLEAN + [("UGA", "2023", 100.1, "f", "Percent")])
    assert set(out) == {"RANGE_VIOLATION"}
    assert set(codes(spark, CLEAN, places=10)) == {"PLACE_COVERAGE_DROP"}
    assert set(codes(spark, CLEAN + [("UGA", "2023", 1.0, "g", "Percent")])) == {"MULTI_FACET"}
    mixed = codes(spark, CLEAN + [("UGA", "2021", 1.0, "f", "Percent")])
    assert set(mixed) == {"MIXED_DATES"}
    assert json.loads(mixed["MIXED_DATES"].evidence) == {"dates": ["2021", "2023"]}


def test_checks_without_a_baseline_are_skipped(spark):
    rows = CLEAN + [("UGA", "2023", 1e9, "f", "Whatever")]
    assert codes(spark, rows, unit=None, low=None, high=None) == {}
    assert codes(spark, [("RWA", "2023", 100.0000005, "f", None)]) == {}


def test_examples_are_limited_but_counts_are_not(spark):
    rows = [(f"A{chr(65 + i)}{chr(65 + j)}", "2023", 500.0, "f", "Percent") for i in range(5) for j in range(5)]
    f = codes(spark, rows)["RANGE_VIOLATION"]
    assert "25 values" in f.message and len(json.loads(f.evidence)["examples"]) == 5


def test_status_rolls_up_the_worst_finding(spark):
    rows = latest(spark, CLEAN + [("UGA", "2021", 1.0, "f", "Percent")])
    wanted = meta(spark).unionByName(meta(spark, key="empty")).unionByName(meta(spark, key="down"))
    facts = quality.pull_facts(rows, wanted)
    found = quality.pull_findings(rows, wanted, facts=facts)
    errors = spark.createDataFrame([("down", "timeout")], "indicator_key string, error string")
    status = quality.pull_status(facts, found, wanted, errors)
    assert {r.indicator_key: (r.status, r.n_places) for r in status.collect()} == {"x": ("warn", 3), "empty": ("fail", 0), "down": ("fail", 0)}
    s = quality.status_summary(status).first()
    assert (s["pass"], s.warn, s.fail, s.batch_ok) == (0, 1, 2, False)
    with pytest.raises(Exception, match="at least one pull failed"):
        quality.require_passing(status).collect()
    assert quality.require_passing(status.where("status = 'warn'")).count() == 1
    sources = spark.createDataFrame([("src", "Source"), ("idle", "Idle")], "source string, source_label string")
    report = {(r.source, r.indicator_key): r.produced_by for r in quality.sources_report(sources, status).collect()}
    assert report[("idle", None)] is None and report[("src", "x")] == "Source"


def test_ceiling_effect(spark, indicators):
    rows = [("A", "2020", 100.0, "f", "u"), ("B", "2020", 99.5, "f", "u"), ("C", "2020", None, "f", "u"), ("D", "2020", 5.0, "f", "u")]
    got = quality.ceiling_effect(latest(spark, rows), indicators(ceiling=100.0)).first()
    assert (got.n_saturated, got.n_total, got.code) == (2, 4, "CEILING_EFFECT")
    assert quality.ceiling_effect(latest(spark, rows), indicators(ceiling=100.0), threshold=0.5).count() == 0
    assert quality.ceiling_effect(latest(spark, rows), indicators()).count() == 0


def test_panel_means(spark, panel):
    df = panel({"A": [10], "B": [20], "C": [None]})
    mean, finding = quality.panel_mean(df)
    assert mean.first()["mean"] == 15 and finding.first().code == "UNWEIGHTED_AGGREGATE"
    weights = spark.createDataFrame([("A", 2000, 3.0), ("B", 2000, 1.0)], "place_id string, period int, weight double")
    mean, finding = quality.panel_mean(df, weights)
    assert mean.first()["mean"] == 12.5 and finding is None


@pytest.mark.parametrize(
    "published, weights, level, code",
    [
        (89.0, [("A", 9.0), ("B", 1.0)], "info", "HEADLINE_CROSS_CHECK"),
        (70.0, [("A", 9.0), ("B", 1.0)], "error", "HEADLINE_CROSS_CHECK"),
        (89.0, [("Q", 9.0)], "error", "CROSS_CHECK_FAILED"),
        (89.0, [("A", 0.0), ("B", 0.0)], "error", "CROSS_CHECK_FAILED"),
    ],
)
def test_weighted_mean_check(spark, panel, published, weights, level, code):
    values = panel({"A": [90], "B": [80]})
    w = spark.createDataFrame(weights, "place_id string, weight double")
    p = spark.createDataFrame([("x", published)], "indicator_key string, published double")
    r = quality.weighted_mean_check(values, w, p).first()
    assert (r.level, r.code) == (level, code)


def test_weight_of_a_place_without_value_stays(spark, panel):
    w = spark.createDataFrame([("A", 1.0), ("B", 1.0)], "place_id string, weight double")
    p = spark.createDataFrame([("x", 45.0)], "indicator_key string, published double")
    r = quality.weighted_mean_check(panel({"A": [90], "B": [None]}), w, p).first()
    assert r.weighted_mean == 45.0 and r.level == "info"


# ---- lineage ----


def by_check(spark, rows, shapes, **options):
    geometry = spark.createDataFrame([(f"country/{p}",) for p in shapes], "place_id string")
    out = lineage.lineage_checks(latest(spark, rows), meta(spark, **options), geometry)
    return {r.check: r for r in out.collect()}


def test_lineage_checks_on_clean_data(spark):
    got = by_check(spark, CLEAN, ["RWA", "KEN"], places=2)
    assert set(got) == {"map_join", "catalog_coverage", "unit_drift", "single_facet", "same_year"}
    assert all(r.passed and r.share == 1.0 for r in got.values())


def test_lineage_checks_name_the_exceptions(spark):
    rows = CLEAN + [("UGA", "2021", 5.0, "a", "Index"), ("TZA", "2020", 5.0, "z", "Percent")]
    got = by_check(spark, rows, ["RWA"], places=7)
    assert (got["map_join"].agree, got["map_join"].total, got["map_join"].offenders) == (1, 4, ["country/KEN", "country/TZA", "country/UGA"])
    assert (got["catalog_coverage"].agree, got["catalog_coverage"].total, got["catalog_coverage"].note) == (4, 7, "7 → 4")
    assert (got["unit_drift"].agree, got["unit_drift"].total, got["unit_drift"].offenders) == (1, 2, ["Index"])
    # All facets but the alphabetically first, although "f" is the dominant one.
    assert (got["single_facet"].agree, got["single_facet"].offenders) == (2, ["f", "z"])
    assert (got["same_year"].agree, got["same_year"].offenders) == (2, ["2020", "2021"])
    others = lineage.non_dominant_facets(latest(spark, rows)).collect()
    assert sorted(r.facet for r in others) == ["a", "z"]
    f = lineage.failing_checks(lineage.lineage_checks(latest(spark, rows), meta(spark), spark.createDataFrame([("country/RWA",)], "place_id string"))).first()
    assert (f.n_failing, f.n_checks) == (4, 4)


def test_checks_without_record_are_absent(spark):
    assert set(by_check(spark, CLEAN, ["RWA"], unit=None)) == {"map_join", "single_facet", "same_year"}


def test_build_lineage(spark):
    rows = latest(spark, CLEAN).withColumns({"provenance_id": F.lit("p/1"), "provenance_url": F.lit(None).cast("string"), "observation_period": F.lit("P1Y")})
    cat = spark.createDataFrame(
        [("x", "undata/sdg/C.SEX--F__AGE--Y", "First", "sdg", "p/0", "https://u", 100.0, "pop", "%", "Percent", 2), ("y", "Plain", "Second", None, None, None, None, None, None, None, None)],
        "indicator_key string, variable_id string, label string, source_agency string, provenance_id string, provenance_url string, saturation_ceiling double, denominator string, unit_display string, unit string, place_coverage bigint",
    )
    shapes = spark.createDataFrame([("country/RWA",)], "place_id string")
    out = lineage.build_lineage(rows, cat, shapes, compared=cat.where("indicator_key = 'x'"))
    s = out.sources.first()
    assert (s.id, s.agency, s.provides, s.period, s.url) == ("p/1", "SDG", "First", "P1Y", "https://u")
    sel = [(r.parameter, r.value) for r in out.selection.where("indicator_key = 'x'").orderBy("position").collect()]
    assert sel == [("variable", "undata/sdg/C.SEX--F__AGE--Y"), ("agency", "sdg"), ("code", "C"), ("parentEntity", "Earth"), ("childType", "Country"), ("dimension: AGE", "Y"), ("dimension: SEX", "F")]
    steps = [r.step for r in out.transformations.where("indicator_key = 'x'").orderBy("position").collect()]
    assert steps[-3:] == ["transform.saturation", "transform.denominator", "transform.merge"]
    assert out.transformations.where("indicator_key = 'y'").count() == 5
    c = out.counts.first()
    assert (c.places, c.geometries, c.indicators, c.sources) == (2, 1, 2, 1)
    assert out.checks.count() == 5 and out.fields.count() == 2


def test_citations(spark, panel):
    cat = spark.createDataFrame(
        [("x", "Access", "p", "https://u", "%", "Percent"), ("y", "Bare", None, None, None, None)],
        "indicator_key string, label string, provenance_id string, provenance_url string, unit_display string, unit string",
    )
    as_of = spark.createDataFrame([("x", "2023")], "indicator_key string, as_of string")
    got = {r.indicator_key: r.citation for r in lineage.citations(cat, as_of).collect()}
    assert got == {"x": "Access · https://u · unit: % · 2023", "y": "Bare"}
    df, cited = panel({"A": [1]}), lineage.citations(cat)
    assert lineage.uncited(df, cited).count() == 0
    assert lineage.require_citations(df, cited).count() == 1
    alien = panel({"A": [1]}, indicator="z")
    assert lineage.uncited(alien, cited).count() == 1
    with pytest.raises(Exception, match="no citation attached"):
        lineage.require_citations(alien, cited).collect()


def test_asymmetries_of_all_pairs_at_once(spark):
    rows = [("a", "P"), ("a", "P"), ("a", "Q"), ("b", "Q"), ("b", "R"), ("c", "Q"), (None, "P")]
    panel = spark.createDataFrame(rows, "indicator_key string, place_id string")
    pairs = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "a"), ("a", "a"), ("c", "none"), (None, "c")], "left_key string, right_key string")
    got = sorted(tuple(str(v) for v in r) for r in coverage.coverage_asymmetries(panel, pairs).collect())
    assert got == [
        ("None", "c", "Q", "right_only"), ("a", "b", "P", "left_only"), ("a", "b", "R", "right_only"),
        ("b", "a", "P", "right_only"), ("b", "a", "R", "left_only"), ("c", "none", "Q", "left_only"),
    ]
