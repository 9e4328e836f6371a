from __future__ import annotations

import itertools
import random

import pytest

import corpus_pipeline
from panelwright.llm import jaccard


def shingles(text, k):
    words = text.lower().split()
    return {tuple(words[i : i + k]) for i in range(max(len(words) - k + 1, 1))} if words else set()


def linked_groups(rows, k, percent):
    sets = {i: shingles(t, k) for i, t in rows}
    least = {i: i for i in sets}
    links = [
        (a, b)
        for a, b in itertools.combinations(sets, 2)
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    for _ in sets:
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    return {i: (len(sets[i]), least[i]) for i in sets}


def copies(base):
    """Near copies by an added block of 5 to 40 % of the words, and by scattered single words."""
    rows = list(base)
    for n, text in enumerate(base[:6]):
        words = text.split()
        for share in range(5, 41, 5):
            rows.append(" ".join(words + [f"new{n}x{share}x{j}" for j in range(len(words) * share // 100)]))
        for every in (30, 50, 70):
            rows.append(" ".join(f"odd{n}" if j % every == every - 1 else w for j, w in enumerate(words)))
    return list(enumerate(rows))


@pytest.mark.parametrize(("k", "percent"), [(5, 80), (1, 50), (3, 90)])
def test_groups_follow_shingle_and_percent(docs, prose, k, percent):
    rows = copies(prose(8, 200, seed=11)) + [(900, "a b"), (901, "A  b"), (902, "a"), (903, "")]
    got = {r._id: (r.n, r.component) for r in jaccard.groups(docs(rows), shingle=k, percent=percent).collect()}
    assert got == linked_groups(rows, k, percent)


def test_pipeline_stage_drops_copies_of_four_fifths_of_five_word_runs(spark, docs, prose):
    base, other = prose(2, 200, seed=12)
    words = base.split()
    block = base + " " + " ".join(f"new{j}" for j in range(36))
    scattered = " ".join("odd" if j % 50 == 30 else w for j, w in enumerate(words))
    far = base + " " + " ".join(f"far{j}" for j in range(60))
    rows = [(1, base), (2, block), (3, scattered), (4, other), (5, far)]
    want = {i for i, (_, least) in linked_groups(rows, 5, 80).items() if i == least}
    assert want == {1, 4, 5} and all(i == least for i, (_, least) in linked_groups(rows, 3, 90).items())
    kept = corpus_pipeline.near_duplicates(spark, docs(rows, extra=True), "")
    assert {r.doc_id for r in kept.collect()} == want


def test_large_groups_are_joined_before_all_pairs_are_searched(docs, prose, monkeypatch):
    rng = random.Random(7)
    (base,) = prose(1, 150, seed=13)
    rows = []
    for i in range(240):
        words, at = base.split(), rng.randrange(3, 140)
        words[at : at + 1 + i % 2] = [f"odd{i}x{j}" for j in range(1 + i % 2)]
        rows.append((i, " ".join(words)))
    rows.append((900, " ".join(prose(1, 150, seed=14))))
    searched = []
    search = jaccard._tree_pairs

    def count(*given, **how):
        found = search(*given, **how)
        searched.append(found.count())
        return found

    monkeypatch.setattr(jaccard, "_tree_pairs", count)
    monkeypatch.setattr(jaccard, "PIVOT_ROUNDS", 1)
    got = {r._id: (r.n, r.component) for r in jaccard.groups(docs(rows)).collect()}
    assert got == linked_groups(rows, 3, 90)
    assert sum(searched) < 3 * len(rows), searched
