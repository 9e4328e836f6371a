"""The decontamination search: what the driver holds, and windows by running sums."""

import tracemalloc

import numpy as np
import pyarrow as pa

from panelwright.llm import decontaminate as D
from panelwright.llm import words as W


def test_driver_holds_one_table_beside_the_result():
    rng = np.random.default_rng(3)
    z = rng.integers(-1000, 1000, (D.BUCKETS, D.DIM)).astype(float)
    z += D.signs() * 5000.0
    weight = np.ones(D.BUCKETS, np.int64)
    tracemalloc.start()
    out = D._latent(z, weight)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out.shape == (D.BUCKETS, D.DIM - D.COMMON)
    assert np.allclose(out.T @ out, np.eye(out.shape[1]), atol=1e-3)
    assert peak < 2 * out.nbytes


def test_signs_of_some_buckets_are_those_of_all():
    assert (D.signs(slice(512, 1024)) == D.signs()[512:1024]).all()


def test_running_sums_wrap_around_as_short_numbers():
    rng = np.random.default_rng(5)
    for n in (0, 1, D.RUN, D.RUN + 1, 5 * D.RUN - 1):
        x = rng.integers(0, 1 << 15, (n, 3)).astype(np.uint16)
        assert (D._running(x)[1:] == np.cumsum(x, axis=0, dtype=np.uint16)).all()
        assert not D._running(x)[0].any()


def test_whole_short_texts_are_windows_of_their_own_words():
    rng = np.random.default_rng(7)
    words = [f"w{i}" for i in range(400)]
    item = " ".join(rng.choice(words, 48))
    table = pa.table({"item_id": [1], "text": [item]})
    latent = rng.normal(size=(D.BUCKETS, 8)).astype(np.float32)
    items = D.Items(table, latent)
    texts = [" ".join(rng.choice(words, n)) for n in (9, 100, 3, 17)] + [" ".join(item.split()[:40]), item]
    ids, _, cosines = D._match(latent, items)(pa.array(texts))
    assert ids == [[], [], [], [], [1], [1]]
    (_, _, w), = W.chunks(pa.array([" ".join(item.split()[:40])]), True)
    v = latent[D._bucket(w.hashes())].sum(axis=0)
    u = latent[D._bucket(items.passages[0][1])].sum(axis=0)
    assert abs(cosines[4][0] - v @ u / np.linalg.norm(v) / np.linalg.norm(u)) < 1e-5
