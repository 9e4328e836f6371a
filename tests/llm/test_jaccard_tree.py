from __future__ import annotations

import itertools

import numpy as np
import pytest

from panelwright.llm import jaccard

KIND = "root long, band long, cid long, n long, comp long"


def table(spark, seed, size, roots, cluster=5):
    """Points in clusters of near copies, below a few roots, and their counts by number."""
    rng = np.random.default_rng(seed)
    centres = rng.poisson(1.2, (size // cluster, jaccard.GROUPS))
    noise = rng.integers(-1, 2, (size, jaccard.GROUPS)) * (rng.random((size, jaccard.GROUPS)) < 0.03)
    counts = np.maximum(centres[np.arange(size) % len(centres)] + noise, 0).astype(np.uint8)
    n = counts.sum(axis=1).astype(np.int64)
    rows = [(i % roots, 0, i, int(n[i]), i % 3 if i % 7 == 0 else i) for i in range(size)]
    curve = jaccard._curve(counts, n)
    points = [(i, int(n[i]), counts[i].tobytes(), int(curve[i])) for i in range(size)]
    return (
        rows,
        counts,
        spark.createDataFrame(rows, KIND),
        spark.createDataFrame(points, "cid long, n long, counts binary, curve long"),
    )


def bounded(rows, counts, percent):
    out = set()
    for (ra, _, a, na, ca), (rb, _, b, nb, cb) in itertools.combinations(rows, 2):
        most = int(np.minimum(counts[a], counts[b]).sum(dtype=int))
        if ra == rb and ca != cb and (100 + percent) * most >= percent * (na + nb):
            out.add((a, b))
    return out


@pytest.mark.parametrize(("leaf", "bits", "roots"), [(64, 4, 3), (4, 1, 1), (2, 2, 2)])
def test_the_tree_finds_every_pair_the_bound_allows(spark, leaf, bits, roots):
    rows, counts, labelled, points = table(spark, leaf, 160, roots)
    got = {(r.a, r.b) for r in jaccard._tree_pairs(labelled, points, 90, leaf, bits).collect()}
    want = bounded(rows, counts, 90)
    assert want and got == want


def test_like_points_share_leaves_and_far_boxes_do_not_meet(spark, monkeypatch):
    asked = []
    meet = jaccard._meeting_leaves

    def count(levels, *how):
        found = meet(levels, *how)
        asked.append((len(levels), levels[0].count(), found.count()))
        return found

    monkeypatch.setattr(jaccard, "_meeting_leaves", count)
    _, _, labelled, points = table(spark, 5, 400, 1, cluster=40)
    jaccard._tree_pairs(labelled, points, 90, 4, 2)
    depth, leaves, met = asked[0]
    assert depth > 1 and met < leaves * (leaves - 1) // 4, (leaves, met)


def test_counts_come_back_from_either_width():
    counts = np.random.default_rng(1).poisson(2, (50, jaccard.GROUPS)).astype(np.uint8)
    counts[1::3, 5], counts[2::5, 7], counts[3::7, 0], counts[4::7] = 200, jaccard.FULL, 16, 15
    packed = jaccard._narrow(counts)
    assert {len(x.as_py()) for x in packed} == {jaccard.GROUPS // 2, jaccard.GROUPS}
    assert (jaccard._points(packed) == counts).all() and (jaccard._points(packed.slice(3)) == counts[3:]).all()
    assert jaccard._points(jaccard._narrow(counts[:0])).shape == (0, jaccard.GROUPS)
