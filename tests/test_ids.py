import pytest
from pyspark.sql import functions as F

from panelwright.functions import ids
from panelwright.functions.text import fixed, signed

CASES = {
    "undata/agri/RAIN_DAYS": ("agri", "RAIN_DAYS", {}, True),
    "undata/agri/RAIN_DAYS.SEASON--WET_2": ("agri", "RAIN_DAYS", {"SEASON": "WET_2"}, True),
    "undata/postal/LETTERS.CARRIER--_Z__SIZE--L4__ZONE--N": ("postal", "LETTERS", {"SIZE": "L4", "ZONE": "N"}, True),
    "undata/tram/RIDES.DAY--SUN__LINE--7": ("tram", "RIDES", {"DAY": "SUN", "LINE": "7"}, True),
    "undata/tram/R.LOOSE__LINE--7": ("tram", "R", {"LINE": "7"}, True),
    "undata/tram/R.LINE--7__LINE--8": ("tram", "R", {"LINE": "8"}, True),
    "undata/p/q/R.S--T--U": ("p", "q/R", {"S": "T--U"}, True),
    "undata/ALONE": (None, "ALONE", {}, False),
    "Number_Of_Trees": (None, "Number_Of_Trees", {}, False),
    "worldbank/TREES.PER.KM": ("worldbank", "TREES.PER.KM", {}, False),
    "worldBank/TREES_KM": (None, "worldBank/TREES_KM", {}, False),
}


def test_variable_ids_are_taken_apart(spark):
    df = spark.createDataFrame([(c,) for c in CASES], "id string")
    for r in df.select(ids.parse_variable_id(F.col("id")).alias("p")).select("p.*").collect():
        assert (r.agency, r.code, r.dimensions, r.is_catalogued) == CASES[r.raw], r.raw


def test_ids_round_trip_in_name_order(spark):
    rows = [("who", "C", {"URBANIZATION": "U", "COOK_FUEL": "CLEAN"}), ("who", "C", {"COOK_FUEL": "CLEAN", "URBANIZATION": "U"}), ("sdg", "X", {}), ("sdg", "X", None)]
    df = spark.createDataFrame(rows, "a string, c string, d map<string,string>")
    got = [r.id for r in df.select(ids.format_variable_id(F.col("a"), F.col("c"), F.col("d")).alias("id")).collect()]
    assert got == ["undata/who/C.COOK_FUEL--CLEAN__URBANIZATION--U"] * 2 + ["undata/sdg/X"] * 2


@pytest.mark.parametrize(
    "code, want",
    [("RWA", "country/RWA"), ("rwa", "country/RWA"), ("", None), (None, None), ("RW", None), ("RWAN", None), ("R1A", None)],
)
def test_country_codes_are_never_guessed(spark, code, want):
    df = spark.createDataFrame([(code,)], "c string")
    assert df.select(ids.country_place_id(F.col("c")).alias("p")).first().p == want


def test_code_after_slash(spark):
    df = spark.createDataFrame([("worldbank/EG.ELC",), ("PLAIN",)], "v string")
    assert [r.c for r in df.select(ids.code_after_slash(F.col("v")).alias("c")).collect()] == ["EG.ELC", "PLAIN"]


def test_numbers_round_like_their_exact_value(spark):
    values = [0.25, 0.35, 12.35, 2.5, -0.15, 1234567.25, 99.95]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for r in df.select("v", fixed("v", 1).alias("a"), signed("v", 1).alias("b"), fixed("v", 0).alias("c")).collect():
        assert r.a == f"{r.v:.1f}" and r.b == f"{r.v:+.1f}" and r.c == f"{r.v:.0f}"
