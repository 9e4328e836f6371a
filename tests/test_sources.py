"""Payloads, second-source rows, snapshots, geometry and the catalog."""

import json

import pytest
from pyspark.sql import functions as F

from panelwright.schema import CURATED, DISCOVERED, SECOND_SOURCE_ROW
from panelwright.sources import catalog, observations

META = "indicator_key string, variable_id string, unit string, unit_display string, source_agency string, dimensions map<string,string>"


def meta(spark, *keys):
    return spark.createDataFrame([(k, f"var/{k}", "Percent", "%", "sdg", {"SEX": "F"}) for k in keys], META)


POINTS = {
    "data": {
        "var/a": {
            "country/RWA": {"date": "2023", "facet": "1", "value": 50.0},
            "country/KEN": {"date": "2021", "facet": "9", "value": 60.0},
        },
        "var/unasked": {"country/RWA": {"date": "2023", "facet": "1", "value": 1.0}},
    },
    "facets": {"1": {"unit": "Percent", "unitDisplayName": "%", "provenanceId": "p/1", "provenanceUrl": "https://u", "observationPeriod": "P1Y"}},
}
SERIES = {
    "data": {"var/a": {"country/RWA": {"facet": "1", "series": [{"date": "2020", "value": 1.0}, {"date": "2021", "value": 2.0}]}, "country/KEN": {"facet": "1", "series": []}}},
    "facets": POINTS["facets"],
}


def payload_file(tmp_path, payload, pretty=False):
    path = tmp_path / "payload.json"
    path.write_text(json.dumps(payload, indent=2 if pretty else None))
    return str(path)


def test_points_become_long_rows(spark, tmp_path):
    payloads = observations.read_payloads(spark, payload_file(tmp_path, POINTS))
    rows = {r.place_id: r for r in observations.decode_points(payloads, meta(spark, "a")).collect()}
    assert set(rows) == {"country/RWA", "country/KEN"}
    r = rows["country/RWA"]
    assert (r.indicator_key, r.period, r.date, r.value, r.unit, r.unit_display) == ("a", 2023, "2023", 50.0, "Percent", "%")
    assert (r.provenance_id, r.provenance_url, r.facet_id, r.source_agency, r.dimensions) == ("p/1", "https://u", "1", "sdg", {"SEX": "F"})
    k = rows["country/KEN"]
    assert (k.facet_id, k.unit, k.provenance_id) == ("9", None, None)


def test_series_give_a_row_per_element(spark, tmp_path):
    payloads = observations.read_payload_documents(spark, payload_file(tmp_path, SERIES, pretty=True))
    rows = observations.decode_series(payloads, meta(spark, "a")).orderBy("date").collect()
    assert [(r.place_id, r.date, r.period, r.value) for r in rows] == [("country/RWA", "2020", 2020, 1.0), ("country/RWA", "2021", 2021, 2.0)]


def test_a_requested_variable_without_data_is_an_error(spark, tmp_path):
    payloads = observations.read_payloads(spark, payload_file(tmp_path, POINTS))
    rows, findings = observations.snapshot_points(payloads, meta(spark, "a", "typo"))
    f = findings.first()
    assert findings.count() == 1 and (f.indicator_key, f.level, f.code) == ("typo", "error", "EMPTY_RESPONSE")
    with pytest.raises(Exception, match="has no data"):
        observations.require_responses(rows, meta(spark, "a", "typo")).collect()
    assert observations.require_responses(rows, meta(spark, "a")).first().n_empty == 0


def test_snapshot_round_trip(spark, tmp_path):
    payloads = observations.read_payloads(spark, payload_file(tmp_path, POINTS))
    latest = observations.decode_points(payloads, meta(spark, "a"))
    names = spark.createDataFrame([("country/RWA", "Rwanda"), ("country/KEN", ""), ("country/XXX", "Other")], "place_id string, place_name string")
    skipped = observations.write_snapshot(latest, meta(spark, "a", "none"), names, str(tmp_path / "snap"))
    assert [r.indicator_key for r in skipped.collect()] == ["none"]
    back, findings = observations.read_snapshot(spark, str(tmp_path / "snap"), meta(spark, "a"))
    columns = ["indicator_key", "place_id", "date", "value", "unit", "facet_id", "provenance_id", "observation_period"]
    key = lambda d: sorted(map(tuple, d.select(*columns).fillna("").collect()))
    assert key(back) == key(latest) and findings.count() == 0
    assert [r.place_id for r in spark.read.json(str(tmp_path / "snap" / "place_names")).collect()] == ["country/RWA"]


def test_a_snapshot_counts_once_its_manifest_is_there(spark, tmp_path):
    payloads = observations.read_payloads(spark, payload_file(tmp_path, POINTS))
    latest = observations.decode_points(payloads, meta(spark, "a"))
    names = spark.createDataFrame([], "place_id string, place_name string")
    path = str(tmp_path / "snap")
    observations.write_snapshot(latest, meta(spark, "a"), names, path)
    # files of a write that never came to its manifest, and a second whole write
    observations.encode_points(latest.withColumn("value", F.lit(-1.0))).write.partitionBy("indicator_key").json(f"{path}/points/write=lost")
    values = lambda: sorted(str(r.value) for r in observations.read_snapshot(spark, path, meta(spark, "a"))[0].collect())
    assert values() == sorted(str(r.value) for r in latest.collect())
    observations.write_snapshot(latest.withColumn("value", F.lit(7.0)), meta(spark, "a"), names, path)
    assert set(values()) == {"7.0"} and len(values()) == latest.count()
    (row,) = observations.read_manifest(spark, path).collect()
    assert row.n_places == latest.count() and row.folder.startswith("write=")


def test_a_place_keeps_the_series_of_each_facet(spark):
    rows = [("a", "v", "P", "f1", "2020", 1.0), ("a", "v", "P", "f1", "2021", 2.0), ("a", "v", "P", "f2", "2020", 9.0), ("a", "v", "Q", "f2", "2020", 5.0)]
    df = spark.createDataFrame(rows, "indicator_key string, variable_id string, place_id string, facet_id string, date string, value double")
    df = df.selectExpr("*", "'u' unit", "'d' unit_display", "'p' provenance_id", "'l' provenance_url", "'P1Y' observation_period")
    about = spark.createDataFrame([("a", "v", "s")], "indicator_key string, variable_id string, source_agency string").selectExpr("*", "map('k', 'v') dimensions")
    back = observations.decode_series(observations.encode_series(df), about)
    got = sorted((r.place_id, r.facet_id, r.date, r.value) for r in back.collect())
    assert got == [("P", "f1", "2020", 1.0), ("P", "f1", "2021", 2.0), ("P", "f2", "2020", 9.0), ("Q", "f2", "2020", 5.0)]


def test_payload_rows_hold_a_bounded_number_of_places(spark):
    n = 400
    df = spark.range(n).select(
        F.lit("a").alias("indicator_key"), F.lit("var/a").alias("variable_id"), F.concat(F.lit("P"), F.col("id")).alias("place_id"),
        F.lit("2020").alias("date"), F.col("id").cast("double").alias("value"), F.lit("f").alias("facet_id"),
        *[F.lit("u").alias(c) for c in ("unit", "unit_display", "provenance_id", "provenance_url", "observation_period")])
    payloads = observations.encode_points(df, per_row=50)
    sizes = [r.n for r in payloads.select(F.size(F.col("data")["var/a"]).alias("n")).collect()]
    assert len(sizes) == 8 and sum(sizes) == n and max(sizes) < 100


# ---- second source ----

WB = [("RWA", "2025", None), ("RWA", "2024", None), ("RWA", "2023", 54.0), ("RWA", "2022", 50.0), ("KEN", "2021", 7.0), ("", "2023", 1.0), (None, "2023", 1.0), ("AFE", "2023", 9.0), ("R1A", "2023", 9.0)]


def second(spark):
    rows = [(None, None, iso, d, v, "", "", 0) for iso, d, v in WB]
    return spark.createDataFrame(rows, SECOND_SOURCE_ROW)


def countries(spark):
    rows = [("RWA", "Rwanda", ("SSF",)), ("KEN", "Kenya", None), ("AFE", "Africa East", ("NA",)), ("TOOLONG", "x", ("SSF",)), ("UGA", "Uganda", (None,))]
    return spark.createDataFrame(rows, "id string, name string, region struct<id:string>")


def test_aggregates_are_no_countries(spark):
    got = {r.place_id: r.place_name for r in observations.real_countries(countries(spark)).collect()}
    assert got == {"country/RWA": "Rwanda", "country/KEN": "Kenya", "country/UGA": "Uganda"}


def test_usable_rows(spark):
    rows = observations.usable_rows(second(spark), observations.real_countries(countries(spark)))
    assert sorted((r.place_id, r.date) for r in rows.collect()) == [("country/KEN", "2021"), ("country/RWA", "2022"), ("country/RWA", "2023")]
    assert observations.usable_rows(second(spark)).where("place_id = 'country/AFE'").count() == 1


def long_rows(spark):
    usable = observations.usable_rows(second(spark), observations.real_countries(countries(spark)))
    cat = spark.createDataFrame([("loss", "worldbank/EG.ELC.LOSS.ZS", "PCT", "% of output", "worldbank", None)], META)
    return observations.with_second_source_facet(usable.withColumn("variable_id", F.lit("worldbank/EG.ELC.LOSS.ZS")), cat)


def test_latest_known_value_with_its_facet(spark):
    got = {r.place_id: r for r in observations.latest_points(long_rows(spark)).collect()}
    r = got["country/RWA"]
    assert (r.date, r.value, r.unit, r.facet_id) == ("2023", 54.0, "PCT", "worldbank/EG.ELC.LOSS.ZS")
    assert (r.provenance_id, r.provenance_url, r.observation_period) == ("worldBank/WDI", "https://data.worldbank.org/indicator/EG.ELC.LOSS.ZS", "P1Y")
    assert got["country/KEN"].date == "2021"


def test_second_source_series(spark):
    payloads = observations.encode_series(long_rows(spark))
    data = payloads.first().data["worldbank/EG.ELC.LOSS.ZS"]
    assert [(p.date, p.value) for p in data["country/RWA"].series] == [("2022", 50.0), ("2023", 54.0)]


def test_sources_are_put_under_each_other(spark, panel):
    both = observations.combine_sources(long_rows(spark), panel({"A": [1]}))
    assert both.count() == 4 and both.where("unit is null").count() == 1


def test_envelopes(spark):
    body = json.dumps([{"page": 1}, [{"countryiso3code": "RWA", "date": "2023", "value": 5.5, "unit": ""}, {"countryiso3code": "KEN", "date": "2022", "value": None}]])
    texts = spark.createDataFrame([(body,)], "value string")
    assert sorted((r.countryiso3code, r.value) for r in observations.unwrap_envelope(texts).collect()) == [("KEN", None), ("RWA", 5.5)]
    bad = spark.createDataFrame([('[{"message": "wrong"}]',)], "value string")
    with pytest.raises(Exception, match="not a"):
        observations.unwrap_envelope(bad).collect()


def test_geometry(spark, tmp_path):
    shapes = {"type": "FeatureCollection", "features": [{"id": "country/RWA", "properties": {"name": "Rwanda"}, "geometry": {"type": "Point", "coordinates": [1, 2]}}, {"id": "country/KEN", "properties": {}, "geometry": None}]}
    path = tmp_path / "g.json"
    path.write_text(json.dumps(shapes, indent=1))
    rows = {r.place_id: r for r in observations.read_geometry(spark, str(path)).collect()}
    assert set(rows) == {"country/RWA", "country/KEN"}
    assert json.loads(rows["country/RWA"].geometry)["coordinates"] == [1, 2]


# ---- catalog ----


def curated(spark, rows):
    full = [{f.name: None for f in CURATED.fields} | r for r in rows]
    return spark.createDataFrame([tuple(r[f.name] for f in CURATED.fields) for r in full], CURATED)


def discovered(spark, rows):
    full = [{f.name: None for f in DISCOVERED.fields} | r for r in rows]
    return spark.createDataFrame([tuple(r[f.name] for f in DISCOVERED.fields) for r in full], DISCOVERED)


def test_curated_fields_win(spark):
    c = curated(spark, [
        {"key": "a", "variable_id": "v/a", "label": "A", "topics": ["e"], "polarity": "lower_is_better", "unit": "mine"},
        {"key": "b", "variable_id": "v/b", "label": "B", "source": "world_bank"}])
    d = discovered(spark, [
        {"key": "a", "variable_id": "other", "label": "Other", "unit": "theirs", "unit_display": "shown", "dimensions": {"SEX": "F"}, "place_coverage": 217, "temporal_start": "2000"},
        {"key": "stray", "label": "Stray"}])
    rows = {r.key: r for r in catalog.merge_catalog(c, d).collect()}
    assert set(rows) == {"a", "b"}
    a, b = rows["a"], rows["b"]
    assert (a.variable_id, a.label, a.unit, a.unit_display, a.place_coverage, a.enriched, a.dimensions) == ("v/a", "A", "mine", "shown", 217, True, {"SEX": "F"})
    assert (b.polarity, b.source, b.enriched, b.dimensions, b.topics, a.source) == ("neutral", "world_bank", False, {}, [], "un_datacommons")


def test_catalog_problems_are_listed(spark):
    c = curated(spark, [
        {"key": "ok", "variable_id": "v", "label": "L", "topics": ["e", "_denominators"], "polarity": "neutral"},
        {"key": "id", "label": "L"}, {"key": "label", "variable_id": "v"},
        {"key": "pol", "variable_id": "v", "label": "L", "polarity": "sideways"},
        {"key": "src", "variable_id": "v", "label": "L", "source": "nowhere"},
        {"key": "top", "variable_id": "v", "label": "L", "topics": ["e", "unknown"]}])
    topics = spark.createDataFrame([("e", 0)], "topic string, ordinal int")
    sources = spark.createDataFrame([("un_datacommons",)], "source string")
    got = {(r.key, r.code, r.detail) for r in catalog.catalog_findings(c, topics, sources).collect()}
    assert got == {("id", "MISSING_ID", None), ("label", "MISSING_LABEL", None), ("pol", "INVALID_POLARITY", "sideways"), ("src", "UNKNOWN_SOURCE", "nowhere"), ("top", "UNKNOWN_TOPIC", "unknown")}
    with pytest.raises(Exception, match="catalog has problems"):
        catalog.require_valid(c, topics, sources).collect()
    assert catalog.require_valid(c.where("key = 'ok'"), topics, sources).first().n_problems == 0


def test_selection_order_and_filter(spark):
    c = curated(spark, [
        {"key": "pop", "label": "Pop", "topics": ["_denominators"], "role": "denominator"},
        {"key": "w", "label": "Water", "topics": ["water"]}, {"key": "z", "label": "zebra", "topics": ["energy"]},
        {"key": "b", "label": "Both", "topics": ["other", "water", "energy"]}, {"key": "a", "label": "Apple", "topics": ["energy"]},
        {"key": "n", "label": "None", "topics": []}])
    topics = spark.createDataFrame([("energy", 0), ("water", 1)], "topic string, ordinal int")
    order = lambda f: [r.key for r in catalog.in_selection_order(catalog.selectable_indicators(c, topics, f)).collect()]
    assert order(None) == order([]) == ["a", "z", "b", "w", "n"]
    assert order(["water"]) == ["b", "w"]
    assert [r.key for r in catalog.indicators_of_topic(c, "energy").orderBy("key").collect()] == ["a", "b", "z"]
    assert [(r.topic, r.position) for r in catalog.topics_of_indicators(c, topics).where("key = 'b'").orderBy("position").collect()] == [("water", 1), ("energy", 2)]


def test_profile_and_discovery(spark, panel):
    df = panel({"A": [1.25, 7], "B": {2003: 0.5, 2004: None}}).withColumns(
        {"facet_id": F.lit("f"), "unit": F.lit("u"), "unit_display": F.lit("U"), "provenance_id": F.lit("p"), "provenance_url": F.lit("https://u")})
    r = catalog.profile_observations(df).first()
    assert (r.place_coverage, r.value_min, r.value_max, r.temporal_start, r.temporal_end) == (2, 0.5, 7.0, "2000", "2003")
    assert (r.facet_count, r.unit, r.provenance_id) == (1, "u", "p")
    mixed = df.withColumn("facet_id", F.col("place_id"))
    r = catalog.profile_observations(mixed).first()
    assert (r.facet_count, r.unit) == (2, None)
    bare = catalog.profile_observations(df.withColumn("facet_id", F.lit(None).cast("string"))).first()
    assert (bare.facet_count, bare.unit) == (0, None)
    c = curated(spark, [{"key": "x", "variable_id": "undata/who/C.SEX--F", "label": "X"}, {"key": "y", "variable_id": "Plain", "label": "Y"}])
    rows = {r.key: r for r in catalog.discovered_rows(c, catalog.profile_observations(df)).collect()}
    assert (rows["x"].source_agency, rows["x"].dimensions, rows["x"].place_coverage, rows["y"].place_coverage) == ("who", {"SEX": "F"}, 2, 0)


def test_profiles_hash_all_rows_and_sort_few(spark):
    rows = [("a", "p", 1.0, "2001", "f", "u", "x"), ("a", "p", 3.0, "2000", "f", "v", "x"), ("a", None, 2.0, "2002", None, "z", "x"),
            (None, "p", 5.0, None, None, "u", "x"), (None, "q", float("nan"), "1999", "f", "u", "x"), ("b", "q", 4.0, "2001", "f", None, "x"),
            ("b", "r", 4.0, "2001", "g", "u", "x")]
    panel = spark.createDataFrame(rows, "indicator_key string, place_id string, value double, date string, facet_id string, unit string, unit_display string")
    panel = panel.withColumns({"provenance_id": F.col("unit"), "provenance_url": F.col("unit")})
    df = catalog.profile_observations(panel)
    got = {r.indicator_key: tuple(r)[1:8] for r in df.collect()}
    assert got == {"a": (1, 1.0, 3.0, "2000", "2002", 1, "v"), None: (1, 5.0, 5.0, None, None, 0, None), "b": (2, 4.0, 4.0, "2001", "2001", 2, None)}
    plan = df._jdf.queryExecution().sparkPlan().toString()
    assert "Expand" not in plan and not [x for x in plan.splitlines() if "SortAggregate" in x and "place_id" in x]


def test_upstream_upsert_and_candidates(spark):
    df = spark.createDataFrame([(" IEA , Paris", "d"), ("", "d"), (None, "d"), (", x", "d"), ("Solo", "d")], "o string, f string")
    assert [r.u for r in df.select(catalog.upstream_producer(F.col("o"), F.col("f")).alias("u")).collect()] == ["IEA", "d", "d", "d", "Solo"]
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "key string, n int, only_old string")
    new = spark.createDataFrame([("b", 9), ("c", 3)], "key string, n int")
    assert {r.key: (r.n, r.only_old) for r in catalog.upsert_metadata(old, new).collect()} == {"a": (1, "x"), "b": (9, None), "c": (3, None)}
    hits = spark.createDataFrame([("undata/who/COOK.SEX--F", "Cooking"), ("worldBank/EG_X", None), ("Count_Person", "People"), ("worldbank/EG.X", "direct")], "variable_id string, name string")
    rows = {r.key: r for r in catalog.candidate_variables(hits).collect()}
    assert set(rows) == {"candidate_cook_who", "candidate_worldbank/eg_x_EG_X"}
    assert rows["candidate_cook_who"].dimensions == {"SEX": "F"} and rows["candidate_worldbank/eg_x_EG_X"].label == "worldBank/EG_X"


def test_upserts_rewrite_only_the_buckets_of_new_keys(spark, tmp_path):
    path = str(tmp_path / "meta")
    old = spark.createDataFrame([(f"k{i}", i, "x") for i in range(60)] + [(None, -1, "x")], "key string, n int, only_old string")
    catalog.write_buckets(old, path, buckets=16)
    files = lambda: {p for p in (tmp_path / "meta").rglob("*.parquet")}
    before = files()
    new = spark.createDataFrame([("k3", 300), ("k3", 301), ("z", 9), (None, -2)], "key string, n int")
    touched = catalog.upsert_buckets(new, path, old.schema, buckets=16)
    assert 1 <= len(touched) <= 3
    gone, come = before - files(), files() - before
    assert gone and come and {p.parent.name for p in gone | come} <= {f"_bucket={b}" for b in touched}
    got = sorted((r.key or "", r.n, r.only_old) for r in catalog.read_buckets(spark, path, old.schema).collect())
    want = [(f"k{i}", i, "x") for i in range(60) if i != 3] + [("k3", 300, None), ("k3", 301, None), ("z", 9, None), ("", -2, None)]
    assert got == sorted(want, key=lambda r: (r[0], r[1]))
    # nothing new, nothing touched
    kept = files()
    assert catalog.upsert_buckets(new.limit(0), path, old.schema, buckets=16) == [] and files() == kept


def test_upserts_refuse_another_table(spark, tmp_path):
    path = str(tmp_path / "meta")
    old = spark.createDataFrame([("a", 1)], "key string, n int")
    catalog.write_buckets(old, path, buckets=4)
    with pytest.raises(ValueError, match="4 buckets"):
        catalog.upsert_buckets(old, path, old.schema, buckets=8)
    with pytest.raises(ValueError, match="extra"):
        catalog.upsert_buckets(old.withColumn("extra", F.lit(1)), path, old.schema, buckets=4)


def test_upsert_into_an_empty_table(spark, tmp_path):
    path = str(tmp_path / "meta")
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "key string, n int")
    catalog.write_buckets(rows.limit(0), path)
    assert catalog.read_buckets(spark, path, rows.schema).count() == 0
    catalog.upsert_buckets(rows, path, rows.schema)
    assert sorted(tuple(r) for r in catalog.read_buckets(spark, path, rows.schema).collect()) == [("a", 1), ("b", 2)]
