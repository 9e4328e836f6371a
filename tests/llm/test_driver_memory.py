"""Rounds of the Jaccard join leave no plans and broadcast tables of ended queries on the driver."""

from panelwright.llm import common, jaccard


def test_rounds_let_the_driver_drop_what_ended(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(jaccard, "forget", lambda s: calls.append(common.forget(s)))
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(i, base + f" x{i}") for i in range(6)] + [(9, "other words here alone")]
    found = jaccard.groups(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["_id"]: r["component"] for r in found.collect()} == {**dict.fromkeys(range(6), 0), 9: 9}
    assert len(calls) >= 2
