"""Phrase mining against plain counts of all phrases."""

from __future__ import annotations

import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelwright.llm import collocations as C

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces(text):
    for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
        yield [w for w in re.split(r"[\x20\x09]+", piece) if w]


def counts_by_hand(rows):
    f, n = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = lang if lang is not None else "und"
        for words in pieces(text):
            n[lang] += len(words)
            for k in range(1, 5):
                f.update((lang, *words[i : i + k]) for i in range(len(words) - k + 1))
    return f, n


def ranks_by_hand(rows, least, top):
    f, n = counts_by_hand(rows)
    frequent = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    inside = collections.Counter()
    for (lang, *p), a in frequent.items():
        for m in range(2, len(p)):
            for i in range(len(p) - m + 1):
                sub = (lang, *p[i : i + m])
                inside[sub] = max(inside[sub], a)
    out = collections.defaultdict(list)
    for (lang, *p), a in frequent.items():
        if 100 * inside[(lang, *p)] >= 80 * a:
            continue
        cuts = []
        for k in range(1, len(p)):
            l, r = f[(lang, *p[:k])], f[(lang, *p[k:])]
            cuts.append((2000000 * a // (l + r), k, l, r))
        score, _, l, r = min(cuts)
        out[lang].append((-score, -a, " ".join(p).encode(), l, r))
    rows = []
    for lang, own in out.items():
        for i, (score, a, p, l, r) in enumerate(sorted(own)[:top]):
            rows.append((lang, i + 1, p.decode(), -a, l, r, n[lang], -score))
    return sorted(rows)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    words = ["a", "b", "c", "Dd", "é", "don't", "x-y", "zz"] + [f"r{i}" for i in range(300)]
    out = [(None, "en"), ("", None), (" \t. ,", "en"), ("one", ""), ("Ⅷ É.é", None)]
    for _ in range(500):
        text = "".join(rng.choice(words[: rng.choice([4, 8, 308])]) + rng.choice([" ", " ", " ", "\t ", ". ", "\n", "\x0b", "; "]) for _ in range(40))
        out.append((text, rng.choice(["en", "de", None, "und"])))
    return out + [("p q r s t " * 60, "de")] * 3 + [("m " * 4000, "en")]


def frame(spark, rows):
    return spark.createDataFrame([(t, g, 1, "x") for t, g in rows], "text string, lang string, a int, P string")


@pytest.mark.parametrize("common,routes", [(1 << 20, None), (40, 3), (0, 16)])
def test_counts_and_ranks_agree_with_plain_counts(spark, docs, rows, common, routes):
    least = 6
    docs([])  # ships the package
    found = C.count_phrases(frame(spark, rows).repartition(3), least, common, routes)
    words = {r.key: (r.lang, r.word) for r in found.words.collect()}
    got = {(words[r.p[0]][0], *(words[k][1] for k in r.p)): r.a for r in found.counts.collect()}
    f, n = counts_by_hand(rows)
    assert got == {p: a for p, a in f.items() if a >= least}
    assert {r.lang: r.n for r in found.totals.collect() if r.n} == {k: v for k, v in n.items() if v}
    for top in (7, 2000):
        assert sorted(tuple(r) for r in C.collocations(found, top).collect()) == ranks_by_hand(rows, least, top)


@pytest.mark.parametrize("least", [1, 3, 30])
def test_quicksort_counts_every_beginning(least):
    rng = np.random.default_rng(least)
    rows = np.where(rng.random((4000, 4)) < 0.4, 7, rng.integers(1, 12, (4000, 4))).astype(np.uint32)
    for k in range(2, 4):
        rows[rng.random(4000) < 0.2, k:] = 0
    weights = rng.integers(1, 4, 4000).astype(np.uint32)
    want = collections.Counter()
    for row, w in zip(rows.tolist(), weights.tolist()):
        for d in range(2, 5):
            if row[d - 1]:
                want[tuple(row[:d])] += w
    head, depth, count = C.partition_counts(rows, weights, least)
    got = {tuple(rows[h, :d].tolist()): c for h, d, c in zip(head, depth, count.tolist())}
    assert len(got) == len(head) and got == {p: c for p, c in want.items() if c >= least}


def test_slabs_end_at_pieces_and_keep_all_words(monkeypatch):
    texts = ["one two. three four; five", "", None, "six seven eight " * 30, "nine\nten", "x." * 50]
    table = pa.array(texts), pa.array(["en", "en", "de", "de", "en", "fr"])
    want = [(i, p) for i, t in enumerate(texts) for p in pieces(t) if p]
    for size in (1, 20, 1 << 20):
        monkeypatch.setattr(C, "SLAB", size)
        got, langs = [], []
        for w, piece, _, lang, names in C.slabs(*table):
            words = [bytes(w.data[a:b]).decode() for a, b in zip(w.starts, w.ends)]
            for p in dict.fromkeys(piece.tolist()):
                got.append([x for x, q in zip(words, piece) if q == p])
            langs += [names[i] for i in lang]
        assert got == [p for _, p in want]
        assert langs == [table[1][i].as_py() for i, p in want for _ in p]


def test_blobs_come_back():
    rng = np.random.default_rng(2)
    high = np.sort(rng.integers(0, 1 << 63, 500).astype(np.uint64))
    low, counts = rng.integers(0, 1 << 63, 500).astype(np.uint64), rng.integers(1, 9, 500).astype(np.uint32)
    for a, b in zip((high, low, counts), C.unpack(C.pack(high, low, counts))):
        assert a.tolist() == b.tolist()


def test_no_rows_and_nothing_frequent(spark, docs):
    docs([])
    for df in (frame(spark, [("a b", "en")]).limit(0), frame(spark, [("a b", "en"), (None, None)])):
        assert C.collocations(C.count_phrases(df)).count() == 0


def test_products_beyond_64_bits(spark):
    words = spark.createDataFrame([(1, "en", "big", 1 << 60), (2, "en", "bang", 1 << 60)], "key long, lang string, word string, n long")
    counts = spark.createDataFrame([([1], 1 << 60), ([2], (1 << 60) + 1), ([1, 2], (1 << 60) - 1)], "p array<long>, a long")
    got = C.collocations(C.Phrases(words, words.groupBy("lang").agg(F.sum("n").alias("n")), counts)).first()
    assert (got.phrase, got.score) == ("big bang", 2000000 * ((1 << 60) - 1) // ((1 << 61) + 1))
