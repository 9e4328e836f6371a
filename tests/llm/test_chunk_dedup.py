"""Chunk recipes against a plain comparison of normal forms, and the way back from chunks to texts."""

from __future__ import annotations

import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from panelwright.llm import chunk_dedup


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def by_hand(rows):
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[normal(t)].append(i)
    out = collections.Counter()
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = min(known, default=None)
        first = True
        for i in sorted(ids, key=lambda i: (i is None, i)):
            out[i, keep, len(ids), first, hashlib.sha256(text.encode()).hexdigest()] += 1
            first = False
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    words = [f"wörd{i}" for i in range(500)]
    long = [" ".join(rng.choice(words) for _ in range(n)) for n in (3, 2000, 9000, 9000)]
    texts = [None, "", " ", "\n\t", "a", " a", "a ", "a\x0bb", "a  b", "a b", "same", "same", "x" * 200_000, "x" * 200_000 + "y"]
    texts += [*long, long[2].replace(" ", "\r\n"), long[2][:-1] + "!", long[3], "x " * 150_000, "x\n" * 150_000]
    out = [(50 - i, t) for i, t in enumerate(texts)]
    return out + [(7, "twice"), (7, "twice"), (None, "same"), (None, "alone"), (None, "alone"), (None, None)]


@pytest.mark.parametrize("bits", [64, 5])
def test_recipes_give_the_groups_of_equal_normal_texts(docs, rows, bits):
    r = chunk_dedup.recipes(docs(rows, extra=True), bits)
    got = collections.Counter(tuple(x) for x in chunk_dedup.groups(r.recipes).collect())
    assert got == by_hand(rows)
    back = {x._row: x.text for x in chunk_dedup.restore(r).collect()}
    kept = {x._row: x for x in r.recipes.collect()}
    assert len(back) == len(rows) and set(back) == set(kept)
    assert collections.Counter(back.values()) == collections.Counter(normal(t) for _, t in rows)
    assert all(len(t.encode()) == kept[i]["_bytes"] for i, t in back.items())
    stored = r.chunks.collect()
    assert len({(x["hash"], x.number) for x in stored}) == len({bytes(x.content) for x in stored}) == len(stored)
    assert (max(x.number for x in stored) > 0) == (bits == 5)


def test_cuts_depend_on_the_content_of_a_text_alone():
    rng = np.random.default_rng(1)
    text = bytes(rng.integers(97, 123, 300_000, dtype=np.uint8))
    edited = text[:1000] + b"insertion" + text[1000:]

    def chunks(*texts):
        out = []
        for _, data, offsets, cuts in chunk_dedup._pieces(pa.array([t.decode() for t in texts])):
            for a, b in zip(offsets[:-1], offsets[1:]):
                ends = chunk_dedup.chunk_ends(int(a), int(b), cuts)
                out.append([bytes(data[x:y]) for x, y in zip([int(a), *ends], ends)])
        return out

    alone, other = chunks(text), chunks(b"before", text, edited)
    assert alone[0] == other[1] and b"".join(alone[0]) == text
    assert len(set(other[2]) - set(alone[0])) <= 2 and len(alone[0]) > 40
    assert max(map(len, chunks(b"z" * 200_000)[0])) == chunk_dedup.LONGEST


def test_no_rows(docs):
    r = chunk_dedup.recipes(docs([(1, "x")]).limit(0))
    assert chunk_dedup.groups(r.recipes).count() == 0 and chunk_dedup.restore(r).count() == 0
