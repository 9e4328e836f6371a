"""Leaves that meet many others go to each cell once."""

import numpy as np
import pyarrow as pa

from panelwright.llm import jaccard as J


def test_a_cell_finds_the_pairs_of_its_leaves_from_one_copy_of_each():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 3, J.GROUPS).astype(np.uint8)
    blobs, corners = [], []
    for _ in range(6):
        counts = np.stack([np.where(rng.random(J.GROUPS) < 0.03, 0, base) for _ in range(5)])
        n = counts.sum(axis=1, dtype=np.int64)
        cid = rng.integers(0, 1 << 60, 5)
        blobs.append(cid.tobytes() + n.tobytes() + cid.tobytes() + counts.tobytes())
        corners.append(counts.max(axis=0).tobytes())
    met = [(i, j) for i in range(6) for j in range(i + 1, 6)]
    one_by_one = {
        tuple(r.values())
        for i, j in met
        for out in J._search(90)(
            [pa.RecordBatch.from_pydict({k: pa.array([v], pa.binary()) for k, v in
                                         {"points_a": blobs[i], "points_b": blobs[j], "corner_b": corners[j]}.items()})]
        )
        for r in out.to_pylist()
    }
    pairs = pa.table({"node_a": [i + 32 for i, _ in met], "node_b": [j + 32 for _, j in met]})
    leaves = pa.table(
        {"node": list(range(32, 38)), "points": pa.array(blobs, pa.binary()), "corner": pa.array(corners, pa.binary())}
    )
    found = J._search_cell(90)(pairs, leaves)
    assert one_by_one and {tuple(r.values()) for r in found.to_pylist()} == one_by_one
