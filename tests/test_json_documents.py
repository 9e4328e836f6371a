"""Documents cut into many byte ranges give the rows that one task reads from the whole."""

import json
import random

import pytest
from pyspark.sql import functions as F

from panelwright.sources import json_documents, observations

ODD = ['plain', 'br{ace}', 'quo"te', 'back\\slash', 'end\\', '}{"', 'new\nline }', 'é漢', '[', '\\"}', ' ']


@pytest.fixture
def small_ranges(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}

    def use(size):
        for n in names:
            spark.conf.set(n, size)

    yield use
    for n, v in before.items():
        spark.conf.set(n, v)


def payload(rng, series, facets_first):
    def observation():
        points = [{"date": f"20{i:02d}", "value": rng.choice([1.5, None, 3])} for i in range(rng.randint(0, 4))]
        own = {"facet": rng.choice(["f1", "f}2", "none"])}
        return own | ({"series": points} if series else {"date": "2020", "value": rng.random()})

    data = {f"{v}/{rng.choice(ODD)}": {f"{p}{rng.choice(ODD)}": observation() for p in range(rng.randint(0, 9))} for v in range(4)}
    facets = {f: {"unit": rng.choice(ODD), "provenanceId": "p"} for f in ("f1", "f}2")}
    parts = [("facets", facets), ("data", data)]
    return dict(parts if facets_first else parts[::-1])


def flat(df):
    rows = df.select(F.explode("data").alias("v", "ps"), "facets").select("v", "facets", F.explode("ps").alias("p", "o"))
    return sorted(map(str, rows.select("v", "p", "o", F.try_element_at("facets", "o.facet").alias("f")).collect()))


@pytest.mark.parametrize("size, indent", [("400b", None), ("900b", 2), ("128m", 2)])
def test_payloads_read_in_ranges_equal_the_whole(spark, tmp_path, small_ranges, size, indent):
    """Four documents at once: points and series, facets first and last."""
    rng = random.Random(f"{size}{indent}")
    small_ranges("128m")
    whole = []
    for i, (series, first) in enumerate([(False, True), (False, False), (True, True), (True, False)]):
        path = tmp_path / f"doc{i}.json"
        path.write_text(json.dumps(payload(rng, series, first), indent=indent, ensure_ascii=i % 2 == 0) + "\n" * (i % 3))
        whole += flat(observations.read_payload_documents(spark, str(path)))
    small_ranges(size)
    assert flat(json_documents.read_payload_parts(spark, str(tmp_path))) == sorted(whole) and len(whole) > 40


def test_features_read_in_ranges_equal_the_whole(spark, tmp_path, small_ranges):
    rng = random.Random(2)
    shapes = [{"type": "Feature", "id": f"f{i}", "properties": {"name": rng.choice(ODD)}, "geometry": {"type": "Polygon", "coordinates": [[[1, 2], [3, i]]]}} for i in range(20)]
    path = tmp_path / "shapes.json"
    path.write_text(json.dumps({"type": "FeatureCollection", "features": shapes}, indent=1))
    def plain(df):
        return sorted((r.place_id, str(r.properties), str(json.loads(r.geometry))) for r in df.collect())

    want = plain(observations.read_geometry(spark, str(path)))
    small_ranges("300b")
    got = observations.geometry_places(json_documents.read_geometry_parts(spark, str(path)))
    assert plain(got) == want and len(want) == 20


def test_many_tasks_read_one_document(spark, tmp_path, small_ranges):
    path = tmp_path / "one.json"
    path.write_text(json.dumps({"data": {"v": {f"p{i}": {"facet": "f", "date": "2020", "value": 1.0} for i in range(400)}}, "facets": {}}))
    small_ranges("1k")
    assert spark.read.option("lineSep", "}").text(str(path)).rdd.getNumPartitions() > 5
    assert json_documents.read_payload_parts(spark, str(path)).count() == 400


def test_documents_one_after_the_other(spark, tmp_path):
    rng = random.Random(9)
    docs = [payload(rng, False, i % 2 == 0) for i in range(5)]
    for d in docs:
        d["facets"] = docs[0]["facets"]
    path = tmp_path / "lines.json"
    path.write_text("\n".join(json.dumps(d) for d in docs) + "\n")
    got = flat(json_documents.read_payload_parts(spark, str(path)))
    assert got == flat(observations.read_payloads(spark, str(path))) and len(got) > 20
