from __future__ import annotations

from panelwright.llm import kneser_ney


def rows_of(docs, texts, model):
    scored, at = kneser_ney.score(docs(texts), model)
    return {r.doc_id: tuple(r[at[x]] for x in kneser_ney.NAMES) for r in scored.collect()}


def test_ranges_grow_with_the_text_and_change_no_score(docs, prose, monkeypatch):
    texts = prose(30, 40, seed=31)
    table = docs(texts).select("text")
    monkeypatch.setattr(kneser_ney, "RANGE_BYTES", 64)
    many = kneser_ney.train(table)
    assert many.shards == -(-sum(len(t) for t in texts) // 64) > kneser_ney.SHARDS
    assert rows_of(docs, texts, many) == rows_of(docs, texts, kneser_ney.train(table, shards=2))


def test_the_query_counts_trigrams(spark, docs, prose, tmp_path):
    table = docs(prose(40, 30, seed=32))
    table.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.score for r in kneser_ney.op1_kneser_ney(spark, str(tmp_path)).collect()}
    training = table.filter(~kneser_ney.held_out(table["doc_id"])).select("text")
    scored, at = kneser_ney.score(table, kneser_ney.train(training, order=3, shards=2))
    assert got == {r.doc_id: r[at["score"]] for r in scored.collect()}
