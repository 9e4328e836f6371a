"""Periodic runs against a search of all periods at all places."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from panelwright.llm import periodic_runs as P

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def runs_by_hand(words, least=12):
    n, out = len(words), set()
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i < n - q and words[i] == words[i + q]:
                i += 1
            length = i - start + q
            if length >= max(least, 2 * q):
                smaller = any(all(words[k] == words[k + p] for k in range(start, start + length - p)) for p in range(1, q))
                if not smaller:
                    out.add((start, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed_by_hand(words, runs):
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def lyndon_by_hand(x):
    return [max(m for m in range(1, len(x) - i + 1) if all(x[i : i + m] < x[i + k : i + m] for k in range(1, m))) for i in range(len(x))]


@pytest.mark.parametrize("letters", [1, 2, 3, 9])
def test_grouping_gives_the_longest_lyndon_words(letters):
    rng = random.Random(letters)
    for n in [1, 2, 3, 5, 8, 13, 21, 34] * 8:
        x = [rng.randint(1, letters) for _ in range(n)]
        if rng.random() < 0.5:
            x = (x[: rng.randint(1, n)] * n)[:n]
        assert P.lyndon_lengths(np.array(x)).tolist() == lyndon_by_hand(x)
        joined = np.array([*x, 0, *x[::-1], 0])
        got = P.lyndon_lengths(joined, 2)
        assert got[:n].tolist() == lyndon_by_hand(x) and got[n + 1 : -1].tolist() == lyndon_by_hand(x[::-1])


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return list(b[:n])


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    out = [None, "", " \n", "one", "a " * 11, "a " * 12, "a b " * 6, "É ß " * 9, "x" * 50, "A a " * 7]
    out += [" ".join(fibonacci(200)), " ".join("ab"[bin(i).count("1") % 2] for i in range(256)), "p q r " * 40 + "q r s t " * 30]
    for _ in range(60):
        words = [rng.choice("abcd") for _ in range(rng.randint(1, 90))]
        for _ in range(rng.randint(0, 3)):
            at, q = rng.randint(0, len(words)), rng.randint(1, 12)
            part = [rng.choice("abcdefgh") for _ in range(q)]
            words[at:at] = (part * 9)[: rng.randint(q, 9 * q)]
        out.append(rng.choice([" ", "\n", "\t \r"]).join(words))
    long = [f"w{i}" for i in range(3000)]
    out.append(" ".join(long + long + ["end"]))
    return out


@pytest.mark.parametrize("least", [12, 5, 2])
def test_runs_agree_with_all_periods_at_all_places(docs, texts, least):
    found, at = P.find_runs(docs(texts, extra=True).selectExpr("*", "1 as _runs"), min_length=least)
    got = {r.doc_id: r for r in found.collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        words = WORD.findall(text or "")
        want = runs_by_hand(words, least) if i < len(texts) - 1 else [(0, 6000, 3000)]
        assert [tuple(r) for r in got[i][at["runs"]]] == want, text[:60]
        assert got[i][at["collapsed"]] == collapsed_by_hand(words, want)


def test_the_query_plants_and_digests(spark, docs, prose, tmp_path):
    rows = [(i, t) for i, t in enumerate(prose(120, 70))] + [(-4, None), (10**12, "a b"), (None, "z " * 30), (7, ""), (7, "")]
    rows += [(900 + i, "k l m " * 8 + t) for i, t in enumerate(prose(30, 50))]
    folder = str(tmp_path)
    docs(rows).write.parquet(f"{folder}/documents.parquet")
    got = sorted((tuple(r) for r in P.op13_lyndon_runs(spark, folder).collect()), key=str)
    want, some = [], 0
    for i, text in rows:
        words = WORD.findall(text or "")
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        g, n = h // 10, len(words)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
        runs = runs_by_hand(words)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        some += best is not None
        lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
        digests = (hashlib.sha256(x.encode()).hexdigest() for x in (lines, collapsed_by_hand(words, runs)))
        want.append((i, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], *digests))
    assert got == sorted(want, key=str) and some > 35


def test_no_rows(docs):
    assert P.find_runs(docs([(1, "x")]).limit(0))[0].count() == 0
