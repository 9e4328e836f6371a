from __future__ import annotations

from panelwright.llm import jaccard


def test_wide_rows_reach_workers_in_small_batches(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BATCH_BYTES", 64 << 10)

    def sizes(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["rows"])

    wide = spark.range(0, 400, 1, 1).selectExpr("cast(repeat('x', 4096) as binary) as points")
    rows = [r.rows for r in jaccard.settle(wide.mapInArrow(sizes, "rows long")).collect()]
    assert sum(rows) == 400 and max(rows) <= 32
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "67108864b"


def test_rounds_end_once_they_link_little(docs, prose, monkeypatch):
    from test_near_duplicates import linked_groups

    rows = []
    for i, text in enumerate(prose(6, 150, seed=21)):
        for j in range(12):
            words = text.split()
            words[3 + 6 * j] = f"odd{j}"
            rows.append((100 * i + j, " ".join(words)))
    asked = []
    stars = jaccard.stars
    monkeypatch.setattr(jaccard, "stars", lambda links, rounds=2: asked.append(rounds) or stars(links, rounds))
    monkeypatch.setattr(jaccard, "WORTH", 1)
    got = {r._id: (r.n, r.component) for r in jaccard.groups(docs(rows)).collect()}
    assert got == linked_groups(rows, 3, 90)
    assert asked in ([1], [1, 1])
