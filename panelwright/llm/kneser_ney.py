"""LM scoring: an interpolated modified Kneser-Ney model of word n-grams.

Tasks count the n-grams of training texts by 64-bit hashes. The counts of a hash range meet in one
shard, which writes them as a sorted array of hashes and an array of counts, and hands on what the
next lower order needs: for each n-gram one more left neighbour of its last words, and for each
context its total and how many of its continuations were seen once, twice, or more often. Orders
are built from the highest to the single words. Workers map the arrays into memory and score texts
by binary search, a sorted batch at a time, so the model is never loaded whole.

A text is its words, lower case in A-Z, and one end; begin marks stand before it. For the highest
order counts are occurrences, below it the number of different left neighbours. Discounts come
from counts of counts; where those are too small for the formula, the discount is 0.5 of the count
class. Unknown words share the mass that single words leave to a uniform distribution over the
vocabulary and one unknown word.

Null and empty texts are an end alone. A null id is the empty text for the split. Repeated rows
count as often as they occur. An empty training table gives a uniform model: every token has
probability 1, as the vocabulary is the unknown word alone.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.llm import shared_files, words as W
from panelwright.llm.common import append, documents, fresh, own_folder, query, settle

#: Order of a model if none is asked for, and of the query.
ORDER, QUERY_ORDER = 2, 3
#: Least hash ranges of each order, and bytes of text for each further one: a range meets in one
#: task, which holds two rows of 64 bytes for each of its n-grams, and some copies of them.
SHARDS = 64
RANGE_BYTES = 4 << 20
#: Tokens a task counts before it hands on what it has.
FLUSH = 1 << 22
BEGIN = np.uint64(0x6B8B4567327B23C6)
END = np.uint64(0x2545F4914F6CDD1D)

#: What is kept of an n-gram: its count, its occurrences, and as a context: its total and the
#: numbers of continuations with counts 1, 2, and 3 or more.
STATS = ("count", "raw", "total", "n1", "n2", "n3")


def _shard(key: np.ndarray, shards: int) -> np.ndarray:
    return ((key >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _gram_key(grams: np.ndarray) -> np.ndarray:
    """Hash of each row of word hashes."""
    n, k = grams.shape
    return W.shingle_hashes(np.ascontiguousarray(grams).ravel(), np.arange(n) * k, k)


def _combine(grams: np.ndarray, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys of distinct n-grams, the n-grams and the sums of their statistics."""
    key = _gram_key(grams)
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    total = np.add.reduceat(stats[order], first, axis=0) if len(key) else stats
    return key[first], grams[order[first]], total


def _planes(x: np.ndarray) -> bytes:
    """Bytes of numbers by their place, which compress better than number by number."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def _unplanes(data: memoryview, kind, n: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data[: n * size], np.uint8).reshape(size, n).T).view(kind).ravel()


def _pack(grams: np.ndarray, stats: np.ndarray) -> bytes:
    """n-grams by a dictionary of their words, and their statistics, compressed."""
    n, k = grams.shape
    words, place = np.unique(grams.ravel(), return_inverse=True)
    parts = [np.array([n, k, len(words)], np.int64).tobytes(), _planes(np.diff(words, prepend=np.uint64(0)))]
    parts += [_planes(place.reshape(n, k)[:, i].astype(np.uint32)) for i in range(k)]
    parts += [_planes(stats[:, i].astype(np.uint64)) for i in range(stats.shape[1])]
    raw = b"".join(parts)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(blob: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    raw = memoryview(pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True))
    n, k, m = np.frombuffer(raw[:24], np.int64)
    at = 24
    words = np.cumsum(_unplanes(raw[at:], np.uint64, m), dtype=np.uint64)
    at += 8 * m
    grams = np.empty((n, k), np.uint64)
    for i in range(k):
        grams[:, i] = words[_unplanes(raw[at:], np.uint32, n)]
        at += 4 * n
    stats = np.empty((n, width), np.int64)
    for i in range(width):
        stats[:, i] = _unplanes(raw[at:], np.uint64, n).view(np.int64)
        at += 8 * n
    return grams, stats


def _token_stream(w: W.Words, order: int) -> tuple[np.ndarray, np.ndarray]:
    """All tokens with ``order - 1`` begin marks before and one end after each text, and where
    each text's first own token stands."""
    h, counts, pad = w.hashes(), w.counts, order - 1
    length = counts + pad + 1
    ends = np.cumsum(length)
    out = np.full(int(ends[-1]) if len(ends) else 0, BEGIN, np.uint64)
    own = ends - length + pad
    out[ends - 1] = END
    out[np.repeat(own, counts) + np.arange(len(h)) - np.repeat(w.first[:-1], counts)] = h
    return out, own


def _grams(stream: np.ndarray, own: np.ndarray, counts: np.ndarray, order: int) -> np.ndarray:
    """One row for each token: it and the ``order - 1`` before it."""
    at = np.repeat(own, counts + 1) + np.arange(int(counts.sum()) + len(counts)) - np.repeat(
        np.cumsum(counts + 1) - counts - 1, counts + 1
    )
    return np.stack([stream[at - order + 1 + i] for i in range(order)], axis=1)


def _deal(grams: np.ndarray, key: np.ndarray, stats: np.ndarray, shards: int):
    """A row for each shard that gets something: its number and its packed part."""
    edges = np.searchsorted(_shard(key, shards), np.arange(shards + 1))  # keys are sorted
    some = np.flatnonzero(np.diff(edges))
    return some, [_pack(grams[edges[i] : edges[i + 1]], stats[edges[i] : edges[i + 1]]) for i in some]


def _count(order: int, shards: int):
    def flush(held: list[np.ndarray]):
        grams = np.concatenate(held)
        key, grams, stats = _combine(grams, np.ones((len(grams), 1), np.int64))
        some, blobs = _deal(grams, key, stats, shards)
        return pa.RecordBatch.from_arrays(
            [pa.array(some.astype(np.int32)), pa.array(blobs, pa.binary())], names=["shard", "part"]
        )

    def run(batches):
        held, n = [], 0
        for batch in batches:
            for _, _, w in W.chunks(batch.column(0), True):
                stream, own = _token_stream(w, order)
                held.append(_grams(stream, own, w.counts, order))
                n += len(held[-1])
                if n >= FLUSH:
                    yield flush(held)
                    held, n = [], 0
        if held:
            yield flush(held)

    return run


_LEVEL_KIND = (
    "level int, shard int, part binary, path string, rows long, raw long, mass long, "
    "c1 long, c2 long, c3 long, c4 long, words long, wide int"
)


def _lower(grams: np.ndarray, count: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, ...]:
    """What n-grams tell the next lower order: of their last words and of their context."""
    n = len(grams)
    tail, head = np.zeros((n, 6), np.int64), np.zeros((n, 6), np.int64)
    tail[:, 0], tail[:, 1] = 1, raw
    head[:, 2] = count
    head[np.arange(n), 2 + np.minimum(count, 3)] = 1
    return _combine(np.concatenate([grams[:, 1:], grams[:, :-1]]), np.concatenate([tail, head]))


def _build(level: int, order: int, shards: int, folder: str):
    """Writes a shard's arrays; returns its row and what it hands on to the lower order."""
    width = 1 if level == order else 6

    def run(table: pa.Table) -> pa.Table:
        parts = [_unpack(x.as_py(), width) for x in table["part"]]
        key, grams, stats = _combine(np.concatenate([g for g, _ in parts]), np.concatenate([s for _, s in parts]))
        raw = stats[:, 0] if level == order else stats[:, 1]
        shard = table["shard"][0].as_py()
        stream, path = shared_files.create(folder, f"grams{level}-{shard:05d}")
        with stream:
            stream.write(key.tobytes())
            kept = stats[:, :1] if level == order else stats
            stream.write(np.ascontiguousarray(kept.T).astype(np.uint32 if kept.max(initial=0) < 1 << 32 else np.uint64).tobytes())
        count = stats[:, 0]
        counts = [int((count == i).sum()) for i in (1, 2, 3, 4)]
        wide = int(kept.max(initial=0) >= 1 << 32)
        out = [(level, shard, None, path, len(key), int(raw.sum()), int(count.sum()), *counts, int((count > 0).sum()), wide)]
        if level > 1:
            real = count > 0  # contexts that end no n-gram of this order
            down_key, down, down_stats = _lower(grams[real], count[real], raw[real])
            some, blobs = _deal(down, down_key, down_stats, shards)
            out += [(level - 1, int(s), b, None, *[0] * 9) for s, b in zip(some, blobs)]
        names = [x.split()[0] for x in _LEVEL_KIND.split(", ")]
        kinds = [pa.int32(), pa.int32(), pa.binary(), pa.string()] + [pa.int64()] * 8 + [pa.int32()]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    return run


class Model:
    """Where the arrays of all orders are, the discounts, and totals. Small: a row per shard."""

    def __init__(self, order: int, shards: int, rows: list[list[dict]]):
        self.order, self.shards = order, shards
        self.files = [{r["shard"]: (r["path"], r["rows"], bool(r["wide"])) for r in level} for level in rows]
        self.discounts = []
        for level in rows:
            c1, c2, c3, c4 = (sum(r[f"c{i}"] for r in level) for i in (1, 2, 3, 4))
            y = c1 / (c1 + 2 * c2) if c1 + 2 * c2 else 0.5
            raw = [i + 1 - (i + 2) * y * b / a if a and b else 0.5 * (i + 1) for i, (a, b) in enumerate([(c1, c2), (c2, c3), (c3, c4)])]
            self.discounts.append(np.array([0.0, *[min(max(d, 1e-3), i + 0.999) for i, d in enumerate(raw)]]))
        words = rows[0]
        self.tokens = sum(r["raw"] for r in words)
        self.mass = sum(r["mass"] for r in words)
        self.vocabulary = 0
        self.left = 0.0
        if words:
            n = [sum(r[f"c{i}"] for r in words) for i in (1, 2)]
            self.vocabulary = sum(r["words"] for r in words)
            many = self.vocabulary - sum(n)
            d = self.discounts[0]
            self.left = (d[1] * n[0] + d[2] * n[1] + d[3] * many) / max(self.mass, 1)
        self._open: dict = {}

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_open"}

    def __setstate__(self, state):
        self.__dict__.update(state, _open={})

    def _arrays(self, level: int, shard: int):
        at = (level, shard)
        if at not in self._open:
            path, n, wide = self.files[level - 1][shard]
            columns = 1 if level == self.order else 6
            kind = np.dtype(np.uint64 if wide else np.uint32)
            whole = shared_files.array(path, np.uint8, n * (8 + columns * kind.itemsize))
            self._open[at] = (whole[: 8 * n].view(np.uint64), whole[8 * n :].view(kind).reshape(columns, n))
        return self._open[at]

    def find(self, level: int, key: np.ndarray) -> np.ndarray:
        """Statistics of each key; zeros where it wasn't seen. A row per statistic."""
        order = np.argsort(key)
        asked = key[order]
        columns = 1 if level == self.order else 6
        out = np.zeros((columns, len(key)), np.int64)
        edges = np.searchsorted(_shard(asked, self.shards), np.arange(self.shards + 1))
        for shard in np.flatnonzero(np.diff(edges)):
            if int(shard) not in self.files[level - 1]:
                continue
            own = slice(edges[shard], edges[shard + 1])
            keys, stats = self._arrays(level, int(shard))
            at = np.minimum(np.searchsorted(keys, asked[own]), len(keys) - 1)
            hit = np.flatnonzero(keys[at] == asked[own])
            out[:, order[own][hit]] = stats[:, at[hit]]
        return out

    def score(self, w: W.Words) -> tuple[np.ndarray, ...]:
        """For each text: tokens, known tokens, base score and score."""
        counts = w.counts
        stream, own = _token_stream(w, self.order)
        grams = _grams(stream, own, counts, self.order)
        of = np.repeat(np.arange(w.texts), counts + 1)
        single, back = np.unique(grams[:, -1], return_inverse=True)
        if self.files[0]:
            stats = self.find(1, _gram_key(single[:, None]))
        else:
            stats = np.zeros((6, len(single)), np.int64)
        d = self.discounts[0]
        count = stats[0]
        p = np.maximum(count - d[np.minimum(count, 3)], 0) / max(self.mass, 1)
        p = p + (self.left if self.mass else 1.0) / (self.vocabulary + 1)
        occurs = stats[1][back]
        base = np.log10((occurs + 1) / (self.tokens + self.vocabulary + 1))
        p = p[back]
        for level in range(2, self.order + 1):
            part = grams[:, self.order - level :]
            below, where = np.unique(_gram_key(part[:, :-1]), return_inverse=True)
            context = self.find(level - 1, below)[2:, where]
            seen, where = np.unique(_gram_key(part), return_inverse=True)
            count = self.find(level, seen)[0, where]
            d = self.discounts[level - 1]
            total = np.maximum(context[0], 1)
            some = np.maximum(count - d[np.minimum(count, 3)], 0) / total
            rest = (d[1] * context[1] + d[2] * context[2] + d[3] * context[3]) / total
            p = np.where(context[0] > 0, some + rest * p, p)
        n = counts + 1
        sums = [np.bincount(of, x, minlength=w.texts) for x in (occurs > 0, base, np.log10(p))]
        return n, sums[0].astype(np.int64), sums[1], sums[2]


def hash_ranges(texts: DataFrame) -> int:
    """Ranges for the texts of the one column of ``texts``, by their bytes."""
    size = texts.agg(F.sum(F.octet_length(F.col(texts.columns[0])).cast("long"))).first()[0] or 0
    return max(SHARDS, -(-size // RANGE_BYTES))


def train(texts: DataFrame, order: int = ORDER, shards: int | None = None) -> Model:
    """Counts the texts of the one column of ``texts`` and writes the model's arrays.

    Results do not depend on ``shards``, which follow from the size of the texts if not given.
    """
    if order < 2:
        raise ValueError("the model interpolates at least two orders")
    if shards is None:
        shards = hash_ranges(texts)
    folder = own_folder(texts.sparkSession, "kneser-ney")
    parts = texts.mapInArrow(_count(order, shards), "shard int, part binary")
    levels: list[list[dict]] = []
    for level in range(order, 0, -1):
        built = settle(parts.groupBy("shard").applyInArrow(_build(level, order, shards, folder), _LEVEL_KIND))
        levels.insert(0, [r.asDict() for r in built.filter("path is not null").drop("part").collect()])
        parts = built.filter("path is null").select("shard", "part")
    return Model(order, shards, levels)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


NAMES = ("n_tokens", "n_known", "base_score", "score")


def score(docs: DataFrame, model: Model, text_column: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with the scores under ``model``, and the column each is in."""
    names = {x: fresh(docs, x) for x in NAMES}

    def work(texts: pa.Array) -> list:
        parts = [model.score(w) for _, _, w in W.chunks(texts, True)]
        return [pa.array(np.concatenate(x)) for x in zip(*parts)] if parts else [[] for _ in NAMES]

    kinds = ("long", "long", "double", "double")
    return append(docs, text_column, ", ".join(f"`{names[x]}` {k}" for x, k in zip(NAMES, kinds)), work), names


def perplexity(score_: float, tokens: int) -> float:
    return math.pow(10.0, -score_ / max(tokens, 1))


@query("op1_kneser_ney")
def op1_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = train(docs.filter(~held_out(F.col("doc_id"))).select("text"), QUERY_ORDER)
    scored, at = score(docs, model)
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.col(at["n_tokens"]).alias("n_tokens"),
        F.col(at["n_known"]).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        F.col(at["base_score"]).alias("base_score"),
        F.col(at["score"]).alias("score"),
    )
