"""What pairs and finished branches take on disk."""

from __future__ import annotations

import os
import random
import uuid

import pytest
from pyspark.sql import functions as F

from panelwright.llm import jaccard
from panelwright.staging import staging_folder
from test_near_duplicates import linked_groups


def size(folders):
    return sum(os.path.getsize(f"{d}/{n}") for top in folders for d, _, names in os.walk(top) for n in names)


@pytest.fixture
def no_broadcast(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, before)


def long_texts(n, words):
    """Texts that share one rare shingle, whose counts the bound can't tell apart."""
    rng = random.Random(3)
    stock = [f"w{i}" for i in range(400)]
    return [" ".join(rng.choice(stock) for _ in range(words)) + " one rare run" for _ in range(n)]


def test_pairs_do_not_carry_their_sets(spark, docs, no_broadcast, monkeypatch, tmp_path):
    texts = long_texts(40, 1500)
    rows = [*enumerate(texts), (900, texts[3] + " and some more"), (901, texts[7]), (902, ""), (903, None)]
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    folders = [f.getPath() for f in manager.localDirs()]
    taken, asked = [], []

    def write(df):
        path, before = f"{tmp_path}/{uuid.uuid4().hex}", size(folders)
        df.write.parquet(path)
        taken.append(size(folders) - before)
        return spark.read.schema(df.schema).parquet(path)

    linked = jaccard._linked
    monkeypatch.setattr(jaccard, "settle_wide", write)
    monkeypatch.setattr(jaccard, "_linked", lambda pairs, *how: asked.append(pairs.count()) or linked(pairs, *how))
    got = {r._id: r.component for r in jaccard.groups(docs(rows), shingle=3, percent=50).collect()}
    assert got == {i: i for i, _ in rows} | {900: 3, 901: 7}
    sets = 40 * 1500 * 8
    assert max(asked) > 700 and max(taken) < 8 * sets, (asked, taken)


def test_sets_are_removed_and_branches_of_two_are_searched_once(spark, docs, prose, monkeypatch):
    rows = []
    for i, text in enumerate(prose(6, 150, seed=31)):
        words = text.split()
        rows.append((10 * i, text))
        rows += [(10 * i + j, " ".join(words[:-j] + ["odd"] * j)) for j in (1, 2)]
        rows += [(10 * i + 3 + j, " ".join(words + [f"new{i}x{x}" for x in range(j)])) for j in (4, 5, 6)]
    for i in (0, 1):  # two texts of words that others hold too, and a run that is theirs alone
        words = rows[6 * i][1].split()
        random.Random(i).shuffle(words)
        rows.append((500 + i, " ".join(words) + " rare run of words"))
    least = []
    search = jaccard._tree_pairs

    def seen(labelled, *how, **more):
        least.append(labelled.groupBy("root", "band").count().agg(F.min("count")).first()[0])
        return search(labelled, *how, **more)

    monkeypatch.setattr(jaccard, "_tree_pairs", seen)
    folder = staging_folder(spark).removeprefix("file://") + "/panelwright"
    before = {x for x in os.listdir(folder) if x.startswith("sets-")} if os.path.isdir(folder) else set()
    got = {r._id: (r.n, r.component) for r in jaccard.groups(docs(rows), percent=90).collect()}
    assert got == linked_groups(rows, 3, 90)
    assert least and all(x is None or x > 2 for x in least)
    assert {x for x in os.listdir(folder) if x.startswith("sets-")} == before
