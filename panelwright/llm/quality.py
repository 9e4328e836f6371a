"""Quality rules: hashed n-gram log-likelihood ratio between trusted texts and the raw corpus.

Two multinomials over hashed one- and two-word features are counted in Spark: one over all
documents, one over trusted (labelled good) documents. A document's score is the mean over its
features of ``ln(p_trusted / p_raw)``. A document stays if it passes the base rules and its score
reaches the threshold. The threshold is a parameter: the same for every document and every run.

Nulls: a null text has no words and fails the base rules; a null id is never trusted. Documents
without words score 0. Repeated rows count as often as they occur. If no document is trusted, or
the table is empty, both models are the uniform one and every score is 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.llm import words as W
from panelwright.llm.common import append, documents, fresh, query

#: Features are dealt to so many buckets.
BUCKETS = 1 << 16
#: So many labelled documents at most are read as trusted, those with the lowest hash of the id.
TRUSTED_BOUND = 20_000
#: Mean log ratio below which a document is rejected.
THRESHOLD = -0.22
#: Counts that smooth both multinomials: each bucket's share of this many features.
PRIOR = 1 << 16

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _features(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words and word pairs, and the text each belongs to."""
    of = np.repeat(np.arange(len(first) - 1), np.diff(first))
    pairs = W.runs(first, 2)
    low = np.uint64(BUCKETS - 1)
    one = (W.mix(h) & low).astype(np.int64)
    two = (W.shingle_hashes(h, pairs, 2) & low).astype(np.int64)
    return np.concatenate([one, two]), np.concatenate([of, of[pairs]])


def _count(trusted: pa.Array):
    """Feature counts of a task: all documents and trusted documents."""

    def run(batches):
        total = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            good = pc.is_in(batch.column(1), value_set=trusted).to_numpy(zero_copy_only=False)
            for a, b, w in W.chunks(batch.column(0), False):
                bucket, of = _features(w.hashes(), w.first)
                total[0] += np.bincount(bucket, minlength=BUCKETS)
                total[1] += np.bincount(bucket[good[a:b][of]], minlength=BUCKETS)
        seen = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays(
            [pa.array(seen.astype(np.int32)), pa.array(total[0, seen]), pa.array(total[1, seen])],
            names=["bucket", "raw", "trusted"],
        )

    return run


def trusted_ids(labels: DataFrame, bound: int = TRUSTED_BOUND) -> DataFrame:
    """Ids of good, harmless documents: the ``bound`` ids with the lowest hashes."""
    good = labels.filter("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null")
    return good.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)


def fit(docs: DataFrame, trusted: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> np.ndarray:
    """``ln(p_trusted / p_raw)`` of every bucket.

    ``trusted`` has at most TRUSTED_BOUND ids, which go to the tasks as they are, so no text is
    moved. What comes back to the driver is one row for each bucket.
    """
    ids = trusted.select("doc_id").distinct().toArrow()["doc_id"].combine_chunks()
    counts = (
        docs.select(F.col(text_column).alias("text"), F.col(id_column).alias("id"))
        .mapInArrow(_count(ids), "bucket int, raw long, trusted long")
        .groupBy("bucket")
        .agg(F.sum("raw").alias("raw"), F.sum("trusted").alias("trusted"))
        .toPandas()
    )
    table = np.zeros((2, BUCKETS))
    table[:, counts["bucket"].to_numpy(int)] = counts[["raw", "trusted"]].to_numpy(float).T
    if table[1].sum() == 0:
        return np.zeros(BUCKETS)
    p = (table + PRIOR / BUCKETS) / (table.sum(axis=1, keepdims=True) + PRIOR)
    return np.log(p[1] / p[0])


def measures(w: W.Words, ratio: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each text: words, characters in words, symbols, repeated lines, repeated words, score."""
    n, offsets = w.texts, w.offsets

    def per_text(mask: np.ndarray) -> np.ndarray:
        upto = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=upto[1:])
        return upto[offsets[1:]] - upto[offsets[:-1]]

    chars = per_text(((w.data & 0xC0) != 0x80) & ~w.space)
    symbols = per_text(_SYMBOL[w.data])

    # lines: cut at \n and at the ends of texts; only those with a word count
    cut = np.zeros(len(w.data) + 1, bool)
    cut[offsets] = True
    breaks = np.flatnonzero(w.data == 10)
    line_start = np.union1d(np.flatnonzero(cut[:-1]), breaks + 1)
    line_start = line_start[line_start < len(w.data)]
    line_end = np.append(line_start[1:], len(w.data))
    ends_in_break = w.data[line_end - 1] == 10 if len(line_end) else np.zeros(0, bool)
    line_end = line_end - ends_in_break
    worded = np.searchsorted(w.starts, line_end) > np.searchsorted(w.starts, line_start)
    line_start, line_end = line_start[worded], line_end[worded]
    line_text = np.searchsorted(offsets, line_start, "right") - 1
    _, at, _ = W.regroup(line_text, w.span_hashes(line_start, line_end), n)
    dup_lines = np.bincount(line_text, minlength=n) - np.diff(at)

    # words in five-word windows that occur again in the same text
    h = w.hashes()
    start = W.runs(w.first, 5)
    of = w.text_of
    window, owner = W.shingle_hashes(h, start, 5), of[start]
    order = W.order_within(owner, window)
    same = (window[order][1:] == window[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    again = np.zeros(len(start), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    cover = np.zeros(len(h) + 1, np.int64)
    np.add.at(cover, start[again], 1)
    np.add.at(cover, start[again] + 5, -1)
    repeated = np.bincount(of[np.cumsum(cover)[:-1] > 0], minlength=n)

    bucket, owner = _features(h, w.first)
    total = np.bincount(owner, ratio[bucket], minlength=n)
    score = total / np.maximum(np.bincount(owner, minlength=n), 1)
    return w.counts, chars, symbols, dup_lines, repeated, score


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score")


def rate(docs: DataFrame, ratio: np.ndarray, text_column: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with the measures, and the column each measure is in."""
    names = {x: fresh(docs, x) for x in NAMES}

    def work(texts: pa.Array) -> list:
        parts = [measures(w, ratio) for _, _, w in W.chunks(texts, False)]
        if not parts:
            return [[] for _ in NAMES]
        return [pa.array(np.concatenate(x)) for x in zip(*parts)]

    kinds = ["long"] * 5 + ["double"]
    added = ", ".join(f"`{names[x]}` {k}" for x, k in zip(NAMES, kinds))
    return append(docs, text_column, added, work), names


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 10) | (100 * n_repeat_words > 20 * n_words)


def keep(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that pass, with the columns they came with."""
    rated, at = rate(docs, fit(docs, trusted_ids(labels)))
    passed = ~base_failed(F.col(at["n_words"]), F.col(at["n_repeat_words"])) & (F.col(at["score"]) >= threshold)
    return rated.filter(passed).select(*[F.col(f"`{c}`") for c in docs.columns])


@query("op8_quality_likelihood")
def op8_quality_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rated, at = rate(docs.select("doc_id", "text"), fit(docs, trusted_ids(labels)))
    failed = base_failed(F.col(at["n_words"]), F.col(at["n_repeat_words"]))
    return rated.select(
        "doc_id",
        *[F.col(at[x]).alias(x) for x in NAMES[:5]],
        failed.alias("base_failed"),
        (~failed & (F.col(at["score"]) >= THRESHOLD)).alias("kept"),
        F.col(at["score"]).alias("score"),
    )
