"""The dealt operators on small tables, against brute force, with the cases each has to bear."""

from __future__ import annotations

import collections
import hashlib
import itertools
import math
import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelwright.llm import (
    chat,
    decontaminate,
    jaccard,
    kneser_ney,
    licenses,
    line_dedup,
    mixing,
    quality,
    sharding,
    token_files,
)
from panelwright.llm import words as W

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", "   \n\t ", "word", "two words", "É ß \x0b x", "same same same", "same same same", "a " * 5000]


def words(text, lower=True):
    return WORD.findall((text or "").translate(LOWER) if lower else text or "")


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} or ({tuple(w)} if w else set())


def components_by_hand(rows):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sets, 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 90 * len(x | y):
            p, q = sorted((find(a), find(b)))
            root[q] = p
    return {i: (len(sets[i]), find(i)) for i in sets}


def edited(text, n):
    w = text.split()
    w[n] = f"changed{n}"
    return " ".join(w)


def test_words_match_a_plain_split_whatever_the_chunks():
    texts = [*ODD, "x" * 3000, "Ab\x0bcd\r\nEf"]
    for size in (1, 7, 1 << 20):
        counts, found = [], []
        for _, _, w in W.chunks(pa.array(texts), True, size):
            counts += w.counts.tolist()
            found += [bytes(w.data[a:b]).decode() for a, b in zip(w.starts, w.ends)]
        assert counts == [len(words(t)) for t in texts]
        assert found == [x for t in texts for x in words(t)]


def test_word_hashes_depend_on_the_bytes_alone():
    one = np.concatenate([w.hashes() for _, _, w in W.chunks(pa.array(["b a", "a b a"]), True, 1)])
    whole = next(W.chunks(pa.array(["b a", "a b a"]), True))[2].hashes()
    assert one.tolist() == whole.tolist() and len(set(one.tolist())) == 2


def test_jaccard_groups_agree_with_all_pairs(docs, prose):
    base = prose(12, 80)
    rows = list(enumerate(ODD + base + [edited(t, 40) for t in base[:6]] + [edited(edited(t, 1), 79) for t in base[:4]]))
    rows += [(100 + i, edited(base[0], i)) for i in range(10, 60, 5)]
    got = {r._id: (r.n, r.component) for r in jaccard.groups(docs(rows, extra=True)).collect()}
    assert got == components_by_hand(rows)


def test_jaccard_on_repeated_rows_null_ids_and_no_rows(docs):
    text = "one two three four five six"
    got = jaccard.groups(docs([(1, text), (1, text), (None, text), (None, None)])).collect()
    assert sorted((r._id or -1, r.component or -1) for r in got) == [(-1, -1), (-1, 1), (1, 1), (1, 1)]
    assert jaccard.groups(docs([(1, "x")]).limit(0)).count() == 0


def test_keeping_one_of_each_group(docs, prose):
    base = prose(3, 90, seed=4)
    rows = [(5, base[0]), (3, edited(base[0], 8)), (9, base[1]), (9, base[1]), (7, None), (8, ""), (None, base[2])]
    kept = jaccard.keep_one(docs(rows, extra=True))
    assert kept.columns[-1] == "target"
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["3", "7", "8", "9", "None"]


def test_quality_measures_agree_with_plain_counts(docs):
    texts = [*ODD, "a b c d e a b c d e x", "line one\nline one\n\n\nline one\r\nline", "#*$%&|<> é", "q w e r t " * 4]
    rated, at = quality.rate(docs(texts, extra=True), np.zeros(quality.BUCKETS))
    rows = {r.doc_id: tuple(r[at[x]] for x in quality.NAMES[:5]) for r in rated.collect()}
    for i, text in enumerate(texts):
        text = text or ""
        w = words(text, False)
        lines = [x for x in text.split("\n") if words(x)]
        windows = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        covered = {k + j for k in range(len(w) - 4) if windows[tuple(w[k : k + 5])] > 1 for j in range(5)}
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))
        assert rows[i] == want, text[:40]


def test_quality_rejects_junk_and_keeps_what_is_like_the_trusted(spark, docs, prose):
    good, junk = prose(80, 60), [" | ".join(t.upper().split()) for t in prose(20, 60, seed=2)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 60)] + [(i, 0, 0) for i in range(80, 90)], "doc_id long, quality int, toxic int")
    table = docs(good + junk, extra=True)
    rated, at = quality.rate(table, quality.fit(table, quality.trusted_ids(labels)))
    score = {r.doc_id: r[at["score"]] for r in rated.collect()}
    lowest, highest = min(score[i] for i in range(80)), max(score[i] for i in range(80, 100))
    assert lowest > highest
    kept = {r.doc_id for r in quality.keep(table, labels, (lowest + highest) / 2).collect()}
    assert kept == set(range(80))
    assert quality.keep(docs([]), labels.limit(0)).count() == 0


def test_shards_grow_only_into_the_new_one(docs):
    rows = [(i, f"text {i}") for i in range(3000)] + [(None, None), (7, "again"), (7, "again")]
    got = sharding.shard_documents(docs(rows, extra=True)).collect()
    assert all(r.grown_shard in (r.shard, 8) for r in got)
    assert 0.06 < sum(r.grown_shard == 8 for r in got) / len(got) < 0.17
    for s in range(8):
        own = sorted(r.slot for r in got if r.shard == s)
        assert own == list(range(len(own))) and 250 < len(own) < 520
    assert len({r.shard for r in got if r.doc_id == 7}) == 1
    assert {(r.size, r.text_crc32) for r in got if r.doc_id is None} == {(1, 0)}


def test_a_changed_weight_moves_rows_only_through_its_subtree(docs):
    tree = sharding.even_tree()
    left, right = tree.children
    heavier = sharding.Node("root", (sharding.Node(left.name, (left.children[0], sharding.Node(left.children[1].name, (
        left.children[1].children[0], sharding.Node("shard3", shard=3, own_weight=3.0))))), right))
    df = docs([(i, "") for i in range(2000)])
    moved = df.select(sharding.place(tree, F.col("doc_id")).alias("a"), sharding.place(heavier, F.col("doc_id")).alias("b")).filter("a <> b")
    assert moved.count() > 100 and moved.filter("b > 3").count() == 0


def test_mix_meets_targets_and_reruns_agree(docs, prose):
    texts = [t for n in (5, 40, 300) for t in prose(40, n, seed=n)]
    rows = [(i, t, f"s{i % 4}" if i % 5 else None) for i, t in enumerate(texts)] + [(500, None, "s0"), (500, None, "s0"), (None, "x y", "zero")]
    inner, at = mixing.mixed(docs(rows, extra=True).select("doc_id", "source", "text"))
    out = inner.select("doc_id", "source", F.col(at["size"]).alias("size"), "target", F.col(at["copies"]).alias("copies")).collect()
    by = collections.defaultdict(list)
    for r in out:
        assert r["copies"] <= 3
        by[r.source].append(r)
    for own in by.values():
        taken = sum(r.size * r["copies"] for r in own)
        assert abs(taken - own[0].target) <= max(r.size for r in own) / 2
    total = sum(r.size for r in out)
    assert math.isclose(sum(own[0].target for own in by.values()), total, rel_tol=1e-9)
    a, b = (sorted(str(r.doc_id) for r in mixing.mix(docs(rows, extra=True)).collect()) for _ in range(2))
    assert a == b and len(a) == sum(r["copies"] for r in out)
    assert mixing.mix(docs([])).count() == 0


def test_lines_of_repeated_windows_go(docs):
    block = "one\ntwo\nthree"
    rows = [(1, f"start\n{block}\nend"), (2, f"{block}\nnew"), (3, block), (4, "\n\n\n"), (5, "\n\n\n"), (6, None), (7, ""), (8, "x\n" * 9 + "x"), (9, "short"), (10, "short")]
    got = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in line_dedup.dedup_lines(docs(rows, extra=True)).collect()}
    assert got[1] == (5, 0, f"start\n{block}\nend") and got[2] == (4, 3, "new") and got[3] == (3, 3, "")
    assert got[4] == got[5] == (4, 0, "\n\n\n") and got[6] == (0, 0, None) and got[7] == (1, 0, "")
    assert got[8] == (10, 9, "x") and got[9] == (1, 0, "short") and got[10] == (1, 1, "")


def test_kneser_ney_sums_to_one_and_agrees_with_plain_counts(docs, prose):
    texts = [*ODD[:8], *prose(30, 40)]
    model = kneser_ney.train(docs(texts).select("text"), shards=3)
    tokens = [[*words(t), "</s>"] for t in texts]
    pairs = collections.Counter((a, b) for t in tokens for a, b in zip(["<s>", *t], t))
    left = collections.Counter(b for _, b in pairs)

    def discounts(counts):
        n = [sum(c == i for c in counts) for i in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] + 2 * n[1] else 0.5
        raw = [i + 1 - (i + 2) * y * n[i + 1] / n[i] if n[i] and n[i + 1] else 0.5 * (i + 1) for i in range(3)]
        return [0, *[min(max(d, 1e-3), i + 0.999) for i, d in enumerate(raw)]]

    d1, d2 = discounts(left.values()), discounts(pairs.values())
    total, rest = collections.Counter(), collections.Counter()
    for (a, _), c in pairs.items():
        total[a] += c
        rest[a] += d2[min(c, 3)]
    mass, free = sum(left.values()), sum(d1[min(c, 3)] for c in left.values())

    def p(a, b):
        low = max(left[b] - d1[min(left[b], 3)], 0) / mass + free / mass / (len(left) + 1)
        c = pairs[a, b]
        return max(c - d2[min(c, 3)], 0) / total[a] + rest[a] / total[a] * low if total[a] else low

    assert math.isclose(sum(p("same", b) for b in [*left, "unseen"]), 1)
    new = [*texts, "same unseen same"]
    scored, at = kneser_ney.score(docs(new, extra=True), model)
    for r in scored.collect():
        t = [*words(new[r.doc_id]), "</s>"]
        want = sum(math.log10(p(a, b)) for a, b in zip(["<s>", *t], t))
        assert math.isclose(r[at["score"]], want, rel_tol=1e-9, abs_tol=1e-9) and r[at["n_tokens"]] == len(t)
    assert model.tokens == sum(map(len, tokens)) and model.vocabulary == len(left)
    three = kneser_ney.score(docs(new), kneser_ney.train(docs(texts).select("text"), order=3, shards=2))[0]
    assert three.filter("_score >= 0 or isnan(_score)").count() == 0


def test_a_model_of_nothing(docs):
    model = kneser_ney.train(docs([]).select("text"), shards=2)
    scored, at = kneser_ney.score(docs(["some words", None]), model)
    assert [(r[at["n_known"]], r[at["score"]]) for r in scored.collect()] == [(0, 0.0), (0, 0.0)]


def test_chat_reads_back_what_went_in(spark):
    texts = ["\\### Assistant: </turn> ok", "", None, "<|endoftext|> ### ### </turn></turn>", "\\\\</turn>\n é漢 \U0001f600", "a: b"]
    rows = [(c, t, r, x) for c, (r, x) in enumerate(itertools.product(["assistant", "user", None, "odd: ### "], texts)) for t in (0, 1)]
    rows += [(None, None, "assistant", "x"), (None, 3, "assistant", "y"), (None, 3, "assistant", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    path = token_files.tokenizer_file("byte_bpe_50k.json")
    got = {r.conv_id: r for r in chat.digests(chat.read_turns(chat.format_turns(df, path), path)).collect()}
    for conv in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == conv]
        whole = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        learned = "".join(r[3] or "" for r in own if r[2] == "assistant")
        assert got[conv].turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()
        assert (got[conv].loss_chars, got[conv].n_turns) == (len(learned), len(own))
        assert got[conv].loss_sha256 == hashlib.sha256(learned.encode()).hexdigest()
    assert chat.digests(chat.read_turns(chat.format_turns(df.limit(0), path), path)).count() == 0


@pytest.mark.parametrize("length", [8, 2048])
def test_token_files_hold_the_tokenizers_ids(docs, prose, length):
    from tokenizers import Tokenizer

    texts = [*ODD, "It's DON'T 12 <|endoftext|>x é Σ ΑΣ ", *prose(20, 200)]
    rows = [(i * 3 - 5, t) for i, t in enumerate(texts)] + [(None, "no id")]
    files = token_files.write(docs(rows, extra=True), token_files.tokenizer_file(), length)
    plain = Tokenizer.from_file(token_files.tokenizer_file())
    got = {r.doc_id: r for r in token_files.read(files, length).collect()}
    start = 0
    for i, t in [rows[-1], *rows[:-1]]:
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 2]
        crc = zlib.crc32(np.array(ids, "<u4").tobytes())
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), crc)
        start += len(ids)
    first = token_files.sequences(files.first().path)
    assert first.schema == token_files.sequence_schema(length)
    assert token_files.read(token_files.write(docs([]), token_files.tokenizer_file())).count() == 0


def test_leaks_are_found_in_any_surroundings(spark, docs, prose):
    items = prose(12, 24, seed=9) + prose(4, 130, seed=10)
    clean = prose(60, 150, seed=11)
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(50, None), (51, "too short")], "item_id long, text string")
    rows = [(i, t) for i, t in enumerate(clean)] + [(1000, None), (1001, "")]
    planted = {}
    for i, item in enumerate(items):
        w = clean[i].split()
        rows.append((200 + i, " ".join([*w[:71], *item.split(), *w[71:]])))
        planted[200 + i] = i
    w = items[0].split()
    rows.append((300, " ".join(["start", *w[:10], "inserted", *w[10:], "end"])))
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs(rows, extra=True), bench).collect()}
    assert {d for d, _ in got} <= {*planted, 300}
    assert len(got & set(planted.items())) >= 0.9 * len(planted) and (300, 0) in got
    left = decontaminate.clean(docs(rows, extra=True), bench)
    assert {r.doc_id for r in left.collect()} == {i for i, _ in rows} - {d for d, _ in got}
    assert decontaminate.leaks(docs(rows), bench.limit(0)).count() == 0


def test_licenses_are_found_with_a_few_changed_words(docs, prose):
    filler = prose(1, 200, seed=3)[0]
    long = licenses.TEMPLATES["MIT permission"]
    changed = long.split()
    changed[4] = changed[60] = "other"
    rows = [(1, f"{filler} {long} {filler}"), (2, f"x {' '.join(changed)}"), (3, filler), (4, None), (5, ""), (6, " ".join(long.split()[:30])),
            (7, "Code.\nReleased under the MIT License.")]
    found, names = licenses.scan(docs(rows, extra=True))
    got = {r.doc_id: r[names[0]] for r in found.collect()}
    assert got == {1: ["MIT permission"], 2: ["MIT permission"], 3: [], 4: [], 5: [], 6: [], 7: ["MIT notice"]}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the tables are not here")
def test_pipeline_and_queries_on_the_tables(spark):
    import duckdb

    import corpus_pipeline
    from panelwright.llm.queries import ORACLES, QUERIES
    from tools import check

    sf = "/root/testdata/sf0.001"
    columns = spark.read.parquet(f"{sf}/documents.parquet").columns
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == columns, name
    assert 0 < corpus_pipeline.run(spark, sf).count()
    con = duckdb.connect()
    for t in check.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for name, sql in ORACLES.items():
        df = QUERIES[name](spark, sf)
        want = con.execute(sql).df()
        key = lambda rows: sorted(tuple(check.plain(v) for v in r) for r in rows)
        names = sorted(df.columns)
        assert sorted(want.columns) == names
        assert key(df.select(*names).toPandas().astype(object).itertuples(index=False, name=None)) == key(
            want[names].astype(object).itertuples(index=False, name=None)
        ), name
