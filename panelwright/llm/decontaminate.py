"""Benchmark decontamination by latent semantic retrieval.

Words are hashed to buckets and weighted by inverse document frequency over all documents. A
randomised singular value decomposition of the TF-IDF passages gives the latent space: every task
multiplies its passages with the same random signs and adds up ``A' (A s)``, the sums meet in Spark,
and the small rest (Nystroem's form of the decomposition) is worked out on the driver, whose
share is fixed by BUCKETS and DIM. The space is fitted on the passages of all documents and all
items; the search then goes over every window of every document. Documents are cut into blocks of eight words, whose latent vectors are added up to
windows about as long as each item; windows near enough to an item by cosine are candidates.
Candidates are decided on the words: by the longest common subsequence of the item with the words
around the window, or, for paraphrases, by a shorter one together with the item's answer word for
word: its last line, or its last ANSWER words if it has one line only. An answer has at least
LEAST_ANSWER words; a shorter last line takes in the words before it. Blocks start every eight
words, but for items too short to hold a block wherever they begin every SHORT_STEP words.

The items are the query set: they are taken in blocks of ITEM_BLOCK, each of which is held against
all documents. Lower case means A-Z. A null or empty text has no windows and is clean; an item
without MIN_WORDS words identifies nothing and is not searched. Items longer than PASSAGE words are
searched by overlapping passages, each of which is enough. Repeated rows and ties give the same
result each. Without items, or without documents, nothing matches.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.llm import words as W
from panelwright.llm.common import append, documents, fresh, query

BUCKETS = 1 << 15
#: Columns of the random signs, and how many of the first singular vectors are left out: they say
#: which language a passage is in, not what it says.
DIM, COMMON = 80, 16
BLOCK = 8
PASSAGE = 64
#: Windows have so many blocks, or one with more starts for items shorter than that. An item is searched in the largest of which one lies inside it
#: wherever it begins, so that what stands around it doesn't count.
SCALES = (1, 2, 3, 4, 5, 7)
FIT_PASSAGE = 32
#: Passages that are summed at once: few enough to stay in a processor's cache, and for their sums of
#: whole numbers to be exact in single precision.
FIT_ROWS = 32
ITEM_BLOCK = 10_000
MIN_WORDS = 8
#: Share of the cosine that a window has with an item of whose like words it is a part.
NEARNESS = 0.3
#: Least common subsequence, as a share of the item, without and with its answer.
COPY, PARAPHRASE = 0.8, 0.5
#: Words of the answer of an item of one line, and of any answer at least.
ANSWER, LEAST_ANSWER = 5, 3
SHORT_STEP = 2
#: Passages of one scale that are held against all windows of a chunk at once.
SCALE_ITEMS = 256
_CHUNK = 1 << 19
_ROWS = 512
#: Rows of a run that is summed up beside all others.
RUN = 64


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64(BUCKETS - 1)).astype(np.int64)


def _document_counts(batches):
    table, docs = np.zeros(BUCKETS, np.int64), 0
    seen = np.zeros((256, BUCKETS), np.uint8)
    for batch in batches:
        docs += batch.num_rows
        for _, _, w in W.chunks(batch.column(0), True):
            bucket = _bucket(w.hashes())
            for a in range(0, w.texts, len(seen)):
                b = min(a + len(seen), w.texts)
                own = slice(w.first[a], w.first[b])
                at = (w.text_of[own] - a) * BUCKETS + bucket[own]
                seen.reshape(-1)[at] = 1
                table += seen[: b - a].sum(axis=0, dtype=np.uint16)
                seen.reshape(-1)[at] = 0
    some = np.flatnonzero(table)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.append(some, -1).astype(np.int32)), pa.array(np.append(table[some], docs))], names=["bucket", "docs"]
    )


def weights(texts: DataFrame) -> tuple[np.ndarray, int]:
    """Whole-number inverse document frequencies of all buckets, and the number of documents."""
    rows = texts.mapInArrow(_document_counts, "bucket int, docs long").groupBy("bucket").agg(F.sum("docs").alias("docs"))
    table = rows.toArrow()
    counts = np.zeros(BUCKETS + 1, np.int64)
    counts[table["bucket"].to_numpy()] = table["docs"].to_numpy()
    total = int(counts[-1])
    return np.rint(256 * np.log((total + 1) / (counts[:-1] + 0.5))).clip(1).astype(np.int64), total


def signs(rows: slice = slice(0, BUCKETS)) -> np.ndarray:
    """Random signs of some buckets, the same everywhere."""
    h = W.mix(np.arange(rows.start * DIM, rows.stop * DIM, dtype=np.uint64) + np.uint64(7919))
    return np.where(h & np.uint64(1), np.float32(1), np.float32(-1)).reshape(-1, DIM)


def _cut(first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of consecutive blocks of ``size`` words that cross no text, and each text's first block."""
    counts = -(-np.diff(first) // size)
    blocks = np.zeros(len(first), np.int64)
    np.cumsum(counts, out=blocks[1:])
    within = np.arange(blocks[-1]) - np.repeat(blocks[:-1], counts)
    return np.repeat(first[:-1], counts) + within * size, blocks


def _sums(table: np.ndarray, bucket: np.ndarray, start: np.ndarray, size: int, ends: np.ndarray) -> np.ndarray:
    """Sums of the table's rows over blocks of at most ``size`` words."""
    out = np.empty((len(start), table.shape[1]), table.dtype)
    whole = start + size <= ends
    for rows in (np.flatnonzero(whole), np.flatnonzero(~whole)):
        at = start[rows]
        total = table[bucket[at]]
        more = np.empty_like(total)
        for i in range(1, size):
            inside = at + i < ends[rows]
            if inside.all():
                total += np.take(table, bucket[at + i], axis=0, out=more, mode="clip")
            else:
                own = np.flatnonzero(inside)
                total[own] += table[bucket[at[own] + i]]
        out[rows] = total
    return out


def _sketch(weight: np.ndarray):
    """Adds up ``A' (A s)`` in whole numbers, so the order of passages doesn't matter."""

    def run(batches):
        sign = signs() * weight[:, None].astype(np.float32)
        seen, place = np.zeros(BUCKETS, bool), np.zeros(BUCKETS, np.int64)
        total, recent, most = np.zeros((BUCKETS, DIM), np.int64), np.zeros((BUCKETS, DIM), np.int32), 0.0
        for batch in batches:
            for _, _, w in W.chunks(batch.column(0), True, _CHUNK // 2):
                if not len(w.starts):
                    continue
                bucket = _bucket(w.hashes())
                own = weight[bucket].astype(np.float64)
                start, _ = _cut(w.first, FIT_PASSAGE)
                edge = np.append(start, len(bucket))
                norm = np.sqrt(np.add.reduceat(own * own, start))
                share = np.rint(64 * own / np.repeat(norm, np.diff(edge)))
                projected = np.rint(64 * _sums(sign, bucket, start, FIT_PASSAGE, edge[1:]) / norm[:, None]).astype(np.float32)
                for a in range(0, len(start), FIT_ROWS):
                    ends = edge[a : a + FIT_ROWS + 1]
                    n, words = len(ends) - 1, slice(ends[0], ends[-1])
                    seen[bucket[words]] = True
                    some = np.flatnonzero(seen)
                    seen[some], place[some] = False, np.arange(len(some))
                    cell = np.repeat(np.arange(n), np.diff(ends)) * len(some) + place[bucket[words]]
                    shares = np.bincount(cell, share[words], n * len(some)).reshape(n, -1).astype(np.float32)
                    y = projected[a : a + FIT_ROWS]
                    most += float(n * shares.max() * np.abs(y).max())
                    if most >= 1 << 31:  # short numbers hold what can't have passed them
                        total += recent
                        recent[:] = 0
                        most = float(n * shares.max() * np.abs(y).max())
                    recent[some] += (shares.T @ y).astype(np.int32)
        total += recent
        blocks = total.reshape(-1, _ROWS, DIM)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(blocks), dtype=np.int32)), pa.array([b.tobytes() for b in blocks], pa.binary())],
            names=["block", "sums"],
        )

    return run


def _add(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_buffer(), np.int64) for x in table["sums"])
    return pa.table(
        {"block": pa.array([table["block"][0].as_py()], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())}
    )


def latent_space(texts: DataFrame, items: DataFrame) -> np.ndarray:
    """The weighted latent vector of each bucket."""
    weight, _ = weights(texts)
    kind = "block int, sums binary"
    # a task sends one table, whatever it read; tables are added in two steps
    parts = texts.unionByName(items.select("text")).mapInArrow(_sketch(weight), kind)
    once = parts.withColumn("part", F.spark_partition_id() % 16).groupBy("block", "part").applyInArrow(_add, kind)
    sums = once.groupBy("block").applyInArrow(_add, kind).toArrow()
    z = np.zeros((BUCKETS, DIM))
    for block, data in zip(sums["block"], sums["sums"]):
        at = block.as_py() * _ROWS
        z[at : at + _ROWS] = np.frombuffer(data.as_buffer(), np.int64).reshape(_ROWS, DIM)
    del sums
    return _latent(z, weight)


def _latent(z: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The weighted latent vector of each bucket from ``A' (A s)``, which is lost.

    Worked out in blocks of buckets: the singular vectors come from the products of the columns with
    each other, so that the driver holds one such table and the result.
    """
    blocks = [slice(a, a + _ROWS) for a in range(0, BUCKETS, _ROWS)]
    core = sum(signs(b).T.astype(float) @ z[b] for b in blocks)
    value, vector = np.linalg.eigh((core + core.T) / 2)
    good = value > max(value[-1], 0) * 1e-9
    if not good.any():
        return np.zeros((BUCKETS, 1), np.float32)
    turn = vector[:, good] / np.sqrt(value[good])
    root = z[:, : turn.shape[1]]
    for b in blocks:
        root[b] = z[b] @ turn
    value, vector = np.linalg.eigh(sum(root[b].T @ root[b] for b in blocks))
    order = np.flatnonzero(value > max(value[-1], 0) * 1e-18)[::-1]
    order = order[min(COMMON, len(order) // 2) :]
    turn = vector[:, order] / np.sqrt(value[order])
    out = np.empty((BUCKETS, len(order)), np.float32)
    for b in blocks:
        out[b] = (root[b] @ turn) * weight[b, None]
    return out


class Items:
    """Passages of benchmark items, by the length of the windows they are searched in."""

    def __init__(self, table: pa.Table, latent: np.ndarray):
        self.ids = table["item_id"].to_pylist()
        self.passages: list[tuple[int, np.ndarray, np.ndarray]] = []
        by_size: dict[int, list[int]] = {}
        for text, at in zip(table["text"].to_pylist(), range(table.num_rows)):
            lines = [x for x in (text or "").split("\n") if x.strip(" \t\r\x0b\x0c")]
            for part, answer in self._parts(text, lines[-1] if len(lines) > 1 else ""):
                size = max((x for x in SCALES if (x + 1) * BLOCK <= len(part) + 1), default=0)
                by_size.setdefault(size, []).append(len(self.passages))
                self.passages.append((at, part, answer))
        scales = []
        for size, members in sorted(by_size.items()):
            vectors = np.array([latent[_bucket(self.passages[i][1])].sum(axis=0) for i in members], np.float32)
            vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
            length = np.array([len(self.passages[i][1]) for i in members])
            level = NEARNESS * np.sqrt(np.minimum(max(size, 1) * BLOCK / length, 1))
            for a in range(0, len(members), SCALE_ITEMS):
                own = slice(a, a + SCALE_ITEMS)
                scales.append((size, np.array(members[own]), vectors[own].T.copy(), level[own].astype(np.float32)))
        self.member = np.zeros((len(self.passages), BUCKETS), bool)
        for i, (_, part, _) in enumerate(self.passages):
            self.member[i, _bucket(part)] = True
        self.length = np.array([len(part) for _, part, _ in self.passages])
        #: Scales that are counted together, and for each bucket which of their passages have a word in it.
        self.slabs: list[tuple[list, np.ndarray]] = []
        while scales:
            upto = np.cumsum([len(x[1]) for x in scales])
            slab = scales[: max(int(np.searchsorted(upto, SCALE_ITEMS, "right")), 1)]
            del scales[: len(slab)]
            table = np.ascontiguousarray(self.member[np.concatenate([x[1] for x in slab])].T).view(np.uint8)
            self.slabs.append((slab, table))
        by_answer: dict[bytes, list[int]] = {}
        for i, (_, _, answer) in enumerate(self.passages):
            by_answer.setdefault(answer.tobytes(), []).append(i)
        self.answers = [(np.frombuffer(x, np.uint64), own) for x, own in by_answer.items()]
        self.begins = np.zeros(1 << 16, bool)
        for answer, _ in self.answers:
            start = answer[:1].copy()
            for i in range(1, LEAST_ANSWER):
                start = start * np.uint64(0x9E3779B97F4A7C15) + answer[i]
            self.begins[start >> np.uint64(48)] = True
        self.masks = []
        for _, part, _ in self.passages:
            mask: dict[int, int] = {}
            for i, h in enumerate(part.tolist()):
                mask[h] = mask.get(h, 0) | (1 << i)
            self.masks.append(mask)

    @staticmethod
    def _parts(text: str | None, last: str):
        whole, answer = (
            next((w.hashes() for _, _, w in W.chunks(pa.array([x or ""], pa.large_string()), True)), np.zeros(0, np.uint64))
            for x in (text, last)
        )
        if len(whole) < MIN_WORDS:
            return
        if not len(answer):
            answer = whole[-ANSWER:]
        elif len(answer) < LEAST_ANSWER:
            answer = whole[-LEAST_ANSWER:]
        step = PASSAGE // 2
        for at in range(0, max(len(whole) - step, 1), step):
            yield whole[at : at + PASSAGE], answer

    def common(self, passage: int, words: list[int]) -> int:
        """Length of the longest common subsequence, a bit for each word of the item."""
        mask, n = self.masks[passage], len(self.passages[passage][1])
        full = (1 << n) - 1
        v = full
        for h in words:
            m = mask.get(h)
            if m:
                u = v & m
                v = ((v + u) | (v - u)) & full
        return n - v.bit_count()

    def answered(self, h: np.ndarray) -> dict[int, np.ndarray]:
        """Where the answer of each passage begins in some words, word for word."""
        if len(h) < LEAST_ANSWER:
            return {}
        start = h[: len(h) - LEAST_ANSWER + 1].copy()
        for i in range(1, LEAST_ANSWER):
            start = start * np.uint64(0x9E3779B97F4A7C15) + h[i : len(start) + i]
        at = np.flatnonzero(self.begins[start >> np.uint64(48)])
        found = {}
        for answer, passages in self.answers:
            own = at[h[at] == answer[0]]
            own = own[own + len(answer) <= len(h)]
            for i in range(1, len(answer)):
                own = own[h[own + i] == answer[i]]
            if len(own):
                found.update(dict.fromkeys(passages, own))
        return found

    def needed(self, answered: dict, passage: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Words of its passage that each window needs: fewer if it holds the answer."""
        share = np.full(len(passage), COPY)
        for i, starts in answered.items():
            own = np.flatnonzero(passage == i)
            first = np.append(starts, 1 << 60)[np.searchsorted(starts, low[own])]
            share[own[first + len(self.passages[i][2]) <= high[own]]] = PARAPHRASE
        return np.ceil(share * self.length[passage] - 1e-6)

    def shared(
        self, passage: np.ndarray, bucket: np.ndarray, low: np.ndarray, high: np.ndarray, need: np.ndarray
    ) -> np.ndarray:
        """Whether each window has enough words of its passage for any decision against it."""
        out = np.zeros(len(passage), bool)
        order = np.argsort(passage, kind="stable")
        edges = np.flatnonzero(np.append(True, np.diff(passage[order]) > 0)) if len(order) else order
        words = np.add.reduceat((high - low)[order], edges) if len(order) else order
        # where windows of a passage overlap so much that one count over all words is less work
        many = 4 * words > len(bucket)
        for i in np.flatnonzero(many):
            own = order[edges[i] : edges[i + 1] if i + 1 < len(edges) else len(order)]
            upto = np.zeros(len(bucket) + 1, np.int32)
            np.cumsum(self.member[passage[own[0]]][bucket], out=upto[1:])
            out[own] = upto[high[own]] - upto[low[own]] >= need[own]
        few = order[np.repeat(~many, np.diff(np.append(edges, len(order))))]
        for at in range(0, len(few), 1 << 14):
            own = few[at : at + (1 << 14)]
            span = np.arange(int((high[own] - low[own]).max(initial=0)))
            word = low[own][:, None] + span
            inside = word < high[own][:, None]
            hit = self.member[passage[own][:, None], bucket[np.minimum(word, len(bucket) - 1)]] & inside
            out[own] = hit.sum(axis=1) >= need[own]
        return out

    def decide(self, passage: int, words: np.ndarray, bucket: np.ndarray, need: float) -> float | None:
        """The shared part of the item if the words hold it, else None. ``need``: least of its words."""
        _, part, answer = self.passages[passage]
        own, mask = words[self.member[passage][bucket]].tolist(), self.masks[passage]
        if sum(min(n, mask[h].bit_count()) for h, n in Counter(own).items() if h in mask) < need:
            return None  # no order of these words has a common subsequence of that length
        share = self.common(passage, own) / len(part)
        if share >= COPY:
            return share
        if share >= PARAPHRASE and len(words) >= len(answer):
            spans = np.lib.stride_tricks.sliding_window_view(words, len(answer))
            if (spans == answer).all(axis=1).any():
                return share
        return None


def _around(first: np.ndarray, wide: int, rest, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end word of windows ``rest`` wider on both sides, within their texts."""
    return np.maximum(first - rest, least), np.minimum(first + wide + rest, most)


def _running(x: np.ndarray) -> np.ndarray:
    """Sums of all rows before each row and the end, as short numbers that wrap around."""
    n, width = x.shape
    out = np.zeros((-(-n // RUN) * RUN + 1, width), np.uint16)
    out[1 : n + 1] = x
    runs = out[1:].reshape(-1, RUN, width)
    for i in range(1, RUN):
        runs[:, i] += runs[:, i - 1]
    before = np.cumsum(runs[:-1, -1], axis=0, dtype=np.uint16)
    runs[1:] += before[:, None]
    return out[: n + 1]


def _near(w: W.Words, latent: np.ndarray, items: Items, bucket: np.ndarray, answered: dict):
    """(text, passage, first word, end word, cosine) of windows near to an item, a word block wider,
    where the blocks around have enough words of it for any decision."""
    start, blocks = _cut(w.first, BLOCK)
    if not len(start):
        return
    ends = np.append(start[1:], len(bucket))
    block = _sums(latent, bucket, start, BLOCK, ends)
    window, grown = block.copy(), 1
    counts = np.diff(blocks)
    text = np.repeat(np.arange(w.texts), counts)
    end = np.repeat(blocks[1:], counts)
    head = np.repeat(blocks[:-1], counts)
    at = np.arange(len(start))
    least = np.array([PARAPHRASE if i in answered else COPY for i in range(len(items.passages))]) * items.length
    least = np.ceil(least - 1e-6).astype(np.uint16)
    for slab, table in items.slabs:
        # differences are those of few blocks, so sums may wrap around
        held = _running(_sums(table, bucket, start, BLOCK, ends))
        column = 0
        for size, members, vectors, level in slab:
            if size:
                use = at[(at + size <= end) | (at == head)]
                first, of = start[use], text[use]
                while grown < size:  # sizes ascend
                    window[: max(len(window) - grown, 0)] += block[grown:]
                    grown += 1
                v = window[use]
                cut = np.flatnonzero(use + size > end[use])  # whole texts
                v[cut] = 0
                for i in range(size if len(cut) else 0):
                    cut = cut[use[cut] + i < end[use[cut]]]
                    v[cut] += block[use[cut] + i]
            else:
                first, texts = _cut(w.first, SHORT_STEP)
                of = np.repeat(np.arange(w.texts), np.diff(texts))
                v = _sums(latent, bucket, first, BLOCK, w.first[of + 1])
            v /= np.maximum(np.sqrt(np.einsum("ij,ij->i", v, v)), 1e-9)[:, None]
            near = v @ vectors
            wide = max(size, 1) * BLOCK
            length = items.length[members]
            rest = np.maximum(length - wide, 0) + np.maximum(length // 4, SHORT_STEP)
            low, high = _around(first, wide, rest.max(), w.first[of], w.first[of + 1])
            low, high = blocks[of] + (low - w.first[of]) // BLOCK, blocks[of] - (w.first[of] - high) // BLOCK
            own = slice(column, column + len(members))
            column += len(members)
            most = np.take(held[:, own], high, axis=0) - np.take(held[:, own], low, axis=0)
            flat = np.flatnonzero((near >= level) & (most >= least[members]))
            hit, which = np.divmod(flat, len(members))
            of, first = of[hit], first[hit]
            low, high = _around(first, wide, rest[which], w.first[of], w.first[of + 1])
            yield of, members[which], low, high, near.ravel()[flat]


def _match(latent: np.ndarray, items: Items):
    def work(texts: pa.Array) -> list:
        ids: list[list] = []
        shares: list[list] = []
        cosines: list[list] = []
        for _, _, w in W.chunks(texts, True, _CHUNK):
            best: list[dict] = [{} for _ in range(w.texts)]
            h = w.hashes()
            bucket = _bucket(h)
            answered = items.answered(h)
            for text, passage, low, high, cosine in _near(w, latent, items, bucket, answered):
                need = items.needed(answered, passage, low, high)
                enough = np.flatnonzero(items.shared(passage, bucket, low, high, need))
                for i in enough[np.lexsort((-cosine[enough], passage[enough], text[enough]))]:
                    item, t = items.passages[passage[i]][0], text[i]
                    if item in best[t]:
                        continue
                    window = slice(low[i], high[i])
                    share = items.decide(passage[i], h[window], bucket[window], need[i])
                    if share is not None:
                        best[t][item] = (share, float(cosine[i]))
            for found in best:
                order = sorted(found)
                ids.append([items.ids[i] for i in order])
                shares.append([found[i][0] for i in order])
                cosines.append([found[i][1] for i in order])
        return [ids, shares, cosines]

    return work


def matched(docs: DataFrame, benchmark: DataFrame, text_column: str = "text"):
    """For each block of items: ``docs`` with the items each text holds, and the new columns' names."""
    spark = docs.sparkSession
    items = benchmark.select("item_id", "text")
    latent = latent_space(docs.select(F.col(text_column).alias("text")), items)
    sent = spark.sparkContext.broadcast(latent)
    names = [fresh(docs, x) for x in ("leak_items", "leak_shares", "leak_cosines")]
    added = f"`{names[0]}` array<bigint>, `{names[1]}` array<double>, `{names[2]}` array<double>"
    blocks = -(-items.count() // ITEM_BLOCK)
    for i in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == i).orderBy("item_id", "text").toArrow()
        yield part, names, added, sent


def _worker(part: pa.Table, sent):
    made: list = []

    def work(texts: pa.Array) -> list:
        if not made:
            made.append(_match(sent.value, Items(part, sent.value)))
        return made[0](texts)

    return work


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id``, ``item_id``, ``share``, ``cosine``: which document holds which item."""
    out = None
    narrow = docs.select("doc_id", "text")
    for part, names, added, sent in matched(narrow, benchmark):
        rows = append(narrow, "text", added, _worker(part, sent)).select(
            "doc_id", F.explode(F.arrays_zip(*names)).alias("m")
        )
        rows = rows.select("doc_id", *[F.col(f"m.{a}").alias(b) for a, b in zip(names, ("item_id", "share", "cosine"))])
        out = rows if out is None else out.union(rows)
    return out if out is not None else narrow.limit(0).selectExpr(
        "doc_id", "cast(null as long) item_id", "cast(null as double) share", "cast(null as double) cosine"
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no item, with the columns they came with."""
    out = docs
    for part, names, added, sent in matched(docs, benchmark):
        seen = append(out, "text", added, _worker(part, sent))
        out = seen.filter(F.size(names[0]) == 0).select(*[F.col(f"`{c}`") for c in docs.columns])
    return out


@query("op7_latent_decontamination")
def op7_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
