from __future__ import annotations

import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """Documents from texts, or from (id, text) or (id, text, source)."""
    from panelwright.llm.common import ship

    ship(spark)

    def build(rows, extra=False):
        full = []
        for i, r in enumerate(rows):
            r = r if isinstance(r, tuple) else (i, r)
            full.append((r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")))
        df = spark.createDataFrame(full, DOC)
        return df.selectExpr("*", "'x' as size", "1 as shard", "2 as _score", "3 as target") if extra else df

    return build


@pytest.fixture(scope="session")
def prose():
    import random

    def build(n, words=60, seed=1):
        rng = random.Random(seed)
        stock = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(3000)]
        return [" ".join(rng.choice(stock) for _ in range(words)) for _ in range(n)]

    return build
