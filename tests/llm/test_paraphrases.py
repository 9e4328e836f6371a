from __future__ import annotations

import random

from panelwright.llm import decontaminate


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_paraphrases_with_the_answer_kept_are_found(spark, docs, prose):
    """Of copies with 10-50 % of the words replaced, at least 0.9 of those a plain LCS decides for."""
    rng = random.Random(4)
    stock = " ".join(prose(40, 80, seed=21)).split()
    lines = prose(40, 24, seed=22)
    items = lines[:20] + [" ".join(t.split()[:16]) + "\n" + " ".join(t.split()[16:]) for t in lines[20:]]
    items += prose(20, 11, seed=23)
    hosts = prose(5 * len(items), 120, seed=24)
    rows, wanted = [], set()
    for i, item in enumerate(items):
        for tenths in range(1, 6):
            w = item.split()
            kept = 8 if "\n" in item else 5
            n = min(int(len(w) * tenths / 10), len(w) - kept)
            for at in rng.sample(range(len(w) - kept), n):
                w[at] = rng.choice(stock)
            assert longest_common(item.split(), w) >= 0.5 * len(w)
            host = hosts[len(rows)].split()
            at = rng.randrange(len(host))
            wanted.add((len(rows), i))
            rows.append((len(rows), " ".join(host[:at] + w + host[at:])))
    rows += [(10_000 + i, t) for i, t in enumerate(prose(100, 150, seed=25))]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs(rows), bench).collect()}
    for kind in (range(20), range(20, 40), range(40, 60)):
        own = {x for x in wanted if x[1] in kind}
        assert len(got & own) >= 0.9 * len(own), kind
    assert got <= wanted


def test_the_space_is_fitted_on_all_documents(spark, docs, prose, monkeypatch):
    seen, plain = spark.sparkContext.accumulator(0), decontaminate._sketch

    def counted(weight):
        run = plain(weight)

        def count(batches):
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch

        return lambda batches: run(count(batches))

    monkeypatch.setattr(decontaminate, "_sketch", counted)
    items = spark.createDataFrame(list(enumerate(prose(5, 20, seed=31))), "item_id long, text string")
    decontaminate.latent_space(docs(prose(9_000, 6, seed=32)).select("text"), items)
    assert seen.value == 9_005
