from __future__ import annotations

import random

import numpy as np
import pyarrow as pa

from panelwright.llm import decontaminate as D

ITEM = " ".join(f"item{i}" for i in range(30))


def items_of(*texts):
    rng = np.random.default_rng(3)
    table = pa.table({"item_id": list(range(len(texts))), "text": list(texts)})
    latent = rng.standard_normal((D.BUCKETS, 16)).astype(np.float32)
    return latent, D.Items(table, latent)


def found(texts, latent, items):
    return D._match(latent, items)(pa.array(texts, pa.large_string()))


def test_no_subsequence_is_worked_out_where_words_or_answer_are_missing(monkeypatch):
    latent, items = items_of(ITEM)
    asked = []
    plain = D.Items.common
    monkeypatch.setattr(D.Items, "common", lambda self, p, words: asked.append(words) or plain(self, p, words))
    words = ITEM.split()
    some = words[:18]  # over half of the item, but neither four fifths of it nor its answer
    often = words[:12] + ["item3"] * 15  # four fifths only where a word counts each time
    assert found([" ".join(some), " ".join(often)], latent, items)[0] == [[], []]
    assert not asked
    copy, answered = words[:25], words[:12] + ["x", "y"] + words[25:]
    assert found([" ".join(copy), " ".join(answered)], latent, items)[0] == [[0], [0]]
    assert asked


def test_bounds_keep_what_all_windows_hold(monkeypatch):
    rng = random.Random(8)
    stock = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choice(stock) for _ in range(rng.choice((9, 14, 20, 33, 47, 70)))) for _ in range(12)]
    latent, items = items_of(*texts)
    hosts = []
    for text in texts * 6:
        words = [w if rng.random() > rng.choice((0, 0.1, 0.3)) else "other" for w in text.split()]
        words[-5:] = text.split()[-5:] if rng.random() < 0.5 else words[-5:]
        hosts.append(" ".join(rng.choices(stock, k=rng.randrange(40)) + words + rng.choices(stock, k=rng.randrange(40))))
    got = found(hosts, latent, items)
    monkeypatch.setattr(D.Items, "answered", lambda self, h: dict.fromkeys(range(len(self.passages)), np.zeros(0, np.int64)))
    monkeypatch.setattr(D.Items, "needed", lambda self, answered, passage, low, high: np.zeros(len(passage)))
    whole = found(hosts, latent, items)
    assert got[0] == whole[0] and got[1] == whole[1]
    assert sum(map(len, got[0])) > len(texts)
    monkeypatch.setattr(D, "SCALE_ITEMS", 3)
    assert found(hosts, latent, items_of(*texts)[1])[0] == got[0]
