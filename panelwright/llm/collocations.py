"""Collocations: frequent phrases of two to four words, scored by how far their parts keep together.

Words are counted first; a phrase can be frequent only if all its words are. The suffixes of all
pieces, cut before the first infrequent word and after four words, are routed by their leading
words, so that all suffixes with one beginning meet in one task. There a multikey three-way
quicksort works on the pointers to them: at each word position a partition falls into suffixes with
a smaller, the same and a greater word than the pivot's; the size of the same part is the count of
the phrase up to that word, and it is worked on at the next word. Partitions with fewer than the
least count are abandoned. All partitions advance together, as one array of pointers.

Two leading words decide the route. Where both are common (over ``COMMON`` occurrences), further
ones count too, up to the first that is not; so a route's largest group is bounded whatever the
text, but for equal suffixes, which a task sends once with their number. Phrases of common words
only then have parts of their count in several routes; these are never abandoned, and summed.

Words travel as numbers: their place in the sorted hashes of the frequent words, which tasks write
to the shared folder and map into memory. Two frequent words of one language with equal 64-bit
hashes would count as one; among a million words that has a chance of one in 30 million.

Pieces end at ``[.,;:!?\\x0A-\\x0D]``, words are ``[^\\x20\\x09]+`` within pieces, lower case for A-Z.
Null texts have no words; a null language is ``und``. Rows count as often as they occur, whatever
their ids. Equal scores are ordered by count, then phrase. A long text is worked in slabs that end
at a piece's end, with about 60 bytes of memory a byte of a slab; a single piece is never cut.
An empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelwright.llm import shared_files
from panelwright.llm import words as W
from panelwright.llm.common import documents, own_folder, query, settle

DEPTH = 4
LEAST = 30
TOP = 2000
#: Parts of a hundred from which a longer phrase stands for a shorter one inside it.
COVERS = 80
#: Occurrences from which a leading word is too common to decide a route.
COMMON = 1 << 20
SLAB = 1 << 20
#: Suffixes a task gathers before it sends them on, and that a route holds on average.
GATHERED, ROUTE = 750_000, 1_000_000
LEAST_ROUTES = 256
#: Frequent words of a file.
FILE_WORDS = 4_000_000

_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True


def slabs(texts: pa.Array, langs: pa.Array):
    """Per slab of the texts: words, the piece and the (word, language) key of each, the language of
    each text, and their names."""
    data, offsets = W.text_bytes(texts)
    coded = langs.dictionary_encode()
    of_text = coded.indices.to_numpy(zero_copy_only=False)
    names = coded.dictionary.to_pylist()
    salts = W.mix(np.array([xxhash.xxh3_64_intdigest(x.encode()) for x in names], np.uint64))
    breaks = _BREAK[data]
    ends = np.union1d(np.flatnonzero(breaks) + 1, offsets[1:])
    at, n = 0, len(data)
    while at < n:
        end = n if at + SLAB >= n else int(ends[np.searchsorted(ends, at + SLAB)])
        first = int(np.searchsorted(offsets, at, "right")) - 1
        last = int(np.searchsorted(offsets, end, "left"))
        own = np.clip(offsets[first : last + 1], at, end) - at
        part = np.where(breaks[at:end], np.uint8(0x20), data[at:end])
        w = W.split(part, own, True)
        text = w.text_of
        piece = np.cumsum(breaks[at:end])[w.starts] + text
        lang = of_text[first:last][text]
        yield w, piece, W.mix(w.hashes() ^ salts[lang]).view(np.int64), lang, names
        at = end


def _count_words(batches):
    """Words of each slab with their number."""
    for batch in batches:
        for w, _, key, lang, names in slabs(batch.column(1), batch.column(0)):
            keys, first, counts = np.unique(key, return_index=True, return_counts=True)
            if not len(keys):
                continue
            raw = w.data.tobytes()
            spans = zip(w.starts[first].tolist(), w.ends[first].tolist())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([names[i] for i in lang[first].tolist()], pa.string()),
                    pa.array([raw[a:b].decode("utf-8") for a, b in spans], pa.string()),
                    pa.array(keys),
                    pa.array(counts),
                ],
                names=["lang", "word", "key", "n"],
            )


def word_counts(docs: DataFrame) -> DataFrame:
    """``lang``, ``word``, ``key``, ``n`` of all words."""
    return docs.mapInArrow(_count_words, "lang string, word string, key long, n long").groupBy("lang", "word", "key").agg(F.sum("n").alias("n"))


class Vocabulary:
    """Frequent words as sorted keys in files. A word's number is its place, counted from 1."""

    def __init__(self, files: list[tuple[str, int, int, int]]):
        self.files = files  # path, words, first key, last key
        self.bases = np.concatenate([[0], np.cumsum([f[1] for f in files])]).astype(np.int64)
        self.highest = np.array([f[3] for f in files], np.int64)
        if self.bases[-1] >= 1 << 32:
            raise ValueError("more frequent words than 32 bits can number")
        self._open: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_open"}

    def __setstate__(self, state):
        self.__dict__.update(state, _open={})

    def _file(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        if i not in self._open:
            path, n = self.files[i][:2]
            whole = shared_files.array(path, np.uint8, 9 * n)
            self._open[i] = whole[: 8 * n].view(np.int64), whole[8 * n :]
        return self._open[i]

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of each key, 0 where it is not frequent, and whether it is common."""
        asked, back = np.unique(keys, return_inverse=True)
        numbers, common = np.zeros(len(asked), np.uint32), np.zeros(len(asked), bool)
        edges = np.concatenate([[0], np.searchsorted(asked, self.highest, "right")])
        for i in np.flatnonzero(np.diff(edges)):
            own = slice(edges[i], edges[i + 1])
            held, often = self._file(int(i))
            at = np.minimum(np.searchsorted(held, asked[own]), len(held) - 1)
            hit = held[at] == asked[own]
            numbers[own] = np.where(hit, at + 1 + self.bases[i], 0)
            common[own] = hit & (often[at] > 0)
        return numbers[back], common[back]

    def keys(self, numbers: np.ndarray) -> np.ndarray:
        """The key of each number, 0 of 0."""
        out = np.zeros(len(numbers), np.int64)
        which = np.searchsorted(self.bases, numbers, "left") - 1
        for i in np.unique(which[numbers > 0]):
            own = np.flatnonzero((which == i) & (numbers > 0))
            out[own] = self._file(int(i))[0][numbers[own].astype(np.int64) - 1 - self.bases[i]]
        return out


def vocabulary(frequent: DataFrame, common: int) -> Vocabulary:
    """Writes the keys of ``frequent`` (key, n) in order. A row per file goes to the driver."""
    spark = frequent.sparkSession
    folder = own_folder(spark, "phrase-words")
    files = max(1, -(-frequent.count() // FILE_WORDS))

    def write(batches):
        import pyspark

        held, often = [], []
        for batch in batches:
            held.append(batch.column(0).to_numpy())
            often.append(batch.column(1).to_numpy() > common)
        keys = np.concatenate(held) if held else np.zeros(0, np.int64)
        if len(keys):
            stream, path = shared_files.create(folder, f"words-{pyspark.TaskContext.get().partitionId():05d}")
            with stream:
                stream.write(keys.tobytes())
                stream.write(np.concatenate(often).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_pydict({"path": [path], "n": [len(keys)], "low": [int(keys[0])], "high": [int(keys[-1])]})

    dealt = frequent.select("key", "n").repartitionByRange(files, "key").sortWithinPartitions("key")
    written = settle(dealt.mapInArrow(write, "path string, n long, low long, high long"))
    return Vocabulary([tuple(r) for r in written.orderBy("low").collect()])


def suffixes(numbers: np.ndarray, piece: np.ndarray) -> np.ndarray:
    """A row of four numbers for each place where two frequent words begin; 0 from the first gap on."""
    n = len(numbers)
    out = np.zeros((n, DEPTH), np.uint32)
    out[:, 0] = numbers
    goes_on = np.ones(n, bool)
    for k in range(1, DEPTH):
        goes_on[max(n - k, 0) :] = False
        goes_on[: n - k] &= (piece[k:] == piece[: n - k]) & (numbers[k:] > 0)
        out[: n - k, k] = np.where(goes_on[: n - k], numbers[k:], 0)
    return out


def _plane(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.dtype.itemsize).T).tobytes()


def _unplane(raw: bytes, kind, n: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, n).T).view(kind).reshape(n)


def pack(high: np.ndarray, low: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted suffixes, compressed: differences of the leading words, bytes of equal weight together."""
    head = np.concatenate([high[:1], np.diff(high)])
    raw = len(high).to_bytes(8, "little") + _plane(head) + _plane(low) + _plane(counts.astype(np.uint32))
    return zstandard.ZstdCompressor(level=1).compress(raw)


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = memoryview(zstandard.ZstdDecompressor().decompress(blob))
    n = int.from_bytes(raw[:8], "little")
    a, b = 8 + 8 * n, 8 + 16 * n
    return np.cumsum(_unplane(raw[8:a], np.uint64, n)), _unplane(raw[a:b], np.uint64, n), _unplane(raw[b:], np.uint32, n)


def route_of(rows: np.ndarray, common: np.ndarray, routes: int) -> np.ndarray:
    """The route of each suffix: by two words, or up to the first that is not common."""
    key = W.mix(rows[:, 0].astype(np.uint64) << np.uint64(32) | rows[:, 1].astype(np.uint64))
    hot = common[:, 0] & common[:, 1]
    for k in (2, 3):
        key = np.where(hot, W.mix(key + rows[:, k].astype(np.uint64) + np.uint64(1)), key)
        hot = hot & common[:, k]
    return (key % np.uint64(routes)).astype(np.int64)


def _send(vocabulary_: Vocabulary, routes: int):
    """Suffixes of a task by route, equal ones once with their number."""

    def flush(held: list):
        rows, common = (np.concatenate(x) for x in zip(*held))
        route = route_of(rows, common, routes)
        high, low = (rows[:, k].astype(np.uint64) << np.uint64(32) | rows[:, k + 1] for k in (0, 2))
        del rows, common
        held.clear()
        order = np.lexsort((low, high, route))
        high, low, route = high[order], low[order], route[order]
        fresh = np.ones(len(high), bool)
        fresh[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1]) | (route[1:] != route[:-1])
        at = np.flatnonzero(fresh)
        counts = np.diff(np.append(at, len(high)))
        high, low, route = high[at], low[at], route[at]
        edges = np.flatnonzero(np.concatenate([[True], route[1:] != route[:-1], [True]]))
        blobs = [pack(high[a:b], low[a:b], counts[a:b]) for a, b in zip(edges[:-1], edges[1:])]
        return pa.RecordBatch.from_arrays([pa.array(route[edges[:-1]], pa.int32()), pa.array(blobs, pa.binary())], names=["route", "suffixes"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for _, piece, key, _, _ in slabs(batch.column(1), batch.column(0)):
                numbers, common = vocabulary_.find(key)
                rows = suffixes(numbers, piece)
                flags = np.zeros(rows.shape, bool)
                for k in range(DEPTH):
                    flags[: len(common) - k, k] = common[k:] if k else common
                flags &= rows > 0
                own = np.flatnonzero((rows[:, 0] > 0) & (rows[:, 1] > 0))
                held.append((rows[own], flags[own]))
                size += len(own)
                if size >= GATHERED:
                    yield flush(held)
                    size = 0
        if size:
            yield flush(held)

    return run


def partition_counts(columns: np.ndarray, weights: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Multikey three-way quicksort of the rows of ``columns`` (from left to right, 0: at its end).

    Returns a row, a depth and a weight for every beginning of two or more columns that weighs
    ``least`` or more. Every round splits all partitions that are left at once.
    """
    pointers = np.arange(len(columns))
    flat, wide = columns.reshape(-1), columns.shape[1]
    sizes, depth = np.array([len(columns)]), np.zeros(1, np.int64)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(pointers):
        starts = np.cumsum(sizes) - sizes
        of = np.repeat(np.arange(len(sizes)), sizes)
        key = flat[pointers * wide + depth[of]]
        three = np.stack([key[starts], key[starts + sizes // 2], key[starts + sizes - 1]])
        pivot = np.median(three, axis=0).astype(key.dtype)
        side = np.where(key == pivot[of], 1, np.where(key < pivot[of], 0, 2))
        parts = len(sizes)
        code = side * parts + of
        weighs = np.bincount(code, weights[pointers], 3 * parts).astype(np.int64).reshape(3, parts)
        counts = np.bincount(code, minlength=3 * parts).reshape(3, parts)
        stays = (weighs >= least) & (counts > 0)
        word = stays[1] & (pivot > 0)
        same = np.flatnonzero(side == 1)
        heads = pointers[same[np.searchsorted(of[same], np.flatnonzero(word))]]
        told = depth[word] > 0
        found.append((heads[told], depth[word][told] + 1, weighs[1][word][told]))
        stays[1] = word & (depth + 1 < wide)
        kept, new_sizes, new_depth = [], [], []
        for s in range(3):
            own = stays[s]
            kept.append(pointers[(side == s) & own[of]])
            new_sizes.append(counts[s][own])
            new_depth.append(depth[own] + (s == 1))
        pointers, sizes, depth = (np.concatenate(x) for x in (kept, new_sizes, new_depth))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3


def _count_phrases(vocabulary_: Vocabulary, least: int):
    def run(_, table):
        high, low, weights = (np.concatenate(x) for x in zip(*(unpack(b) for b in table.column("suffixes").to_pylist())))
        rows = np.stack([high >> np.uint64(32), high, low >> np.uint64(32), low], 1).astype(np.uint32)
        del high, low
        known = np.unique(rows[:, :3])
        keys = vocabulary_.keys(known)
        often = known[vocabulary_.find(keys)[1]] if len(known) else known
        both = np.isin(rows[:, 0], often) & np.isin(rows[:, 1], often)
        out = []
        for own, limit in ((np.flatnonzero(~both), least), (np.flatnonzero(both), 1)):
            part = rows[own]
            head, depth, count = partition_counts(part, weights[own], limit)
            if limit < least and len(head):
                # only beginnings of common words are spread over routes; all others are whole here
                third = np.isin(part[head, 2], often)
                spread = (depth == 2) | ((depth == 3) & third)
                keep = spread | (count >= least)
                head, depth, count = head[keep], depth[keep], count[keep]
            phrase = np.where(np.arange(DEPTH) < depth[:, None], part[head], 0)
            out.append((phrase, depth, count))
        phrase, depth, count = (np.concatenate(x) for x in zip(*out))
        keys = vocabulary_.keys(phrase.reshape(-1)).reshape(phrase.shape)
        inside = np.arange(DEPTH) < depth[:, None]
        ends = np.concatenate([[0], np.cumsum(depth)])
        return pa.table(
            {"p": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys[inside])), "a": pa.array(count, pa.int64())}
        )

    return run


@dataclass
class Phrases:
    """``words``: lang, word, key, n of the frequent words; ``totals``: lang, n; ``counts``: p (keys), a."""

    words: DataFrame
    totals: DataFrame
    counts: DataFrame


def count_phrases(docs: DataFrame, least: int = LEAST, common: int = COMMON, routes: int | None = None) -> Phrases:
    """All phrases of up to four words that occur ``least`` times or more in their language."""
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    words = settle(word_counts(texts))
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    frequent = words.filter(F.col("n") >= least)
    single = frequent.select(F.array("key").alias("p"), F.col("n").alias("a"))
    held = vocabulary(frequent, common)
    if not held.files:
        return Phrases(frequent, totals, single)
    if routes is None:
        tokens = frequent.agg(F.sum("n")).first()[0]
        routes = max(LEAST_ROUTES, -(-tokens // ROUTE))
    sent = texts.mapInArrow(_send(held, routes), "route int, suffixes binary")
    parts = sent.groupBy("route").applyInArrow(_count_phrases(held, least), "p array<long>, a long")
    whole = parts.groupBy("p").agg(F.sum("a").alias("a")).filter(F.col("a") >= least)
    return Phrases(frequent, totals, settle(whole.union(single)))


def _wide(x: str):
    return F.col(x).cast("decimal(19,0)")


def collocations(phrases: Phrases, top: int = TOP) -> DataFrame:
    """The ``top`` phrases of each language by the score of their weakest cut."""
    f = phrases.counts
    candidates = f.filter(F.size("p") > 1)
    cuts = candidates.select("p", "a", F.explode(F.sequence(F.lit(1), F.size("p") - 1)).alias("k"))
    cuts = cuts.select("p", "a", "k", F.slice("p", F.lit(1), F.col("k")).alias("_l"), F.slice("p", F.col("k") + 1, F.size("p")).alias("_r"))
    sides = cuts.join(f.select(F.col("p").alias("_l"), F.col("a").alias("l")), "_l").join(
        f.select(F.col("p").alias("_r"), F.col("a").alias("r")), "_r"
    )
    score = F.expr("cast(2000000 as decimal(7,0)) * cast(a as decimal(19,0)) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    best = sides.groupBy("p").agg(F.min(F.struct(score.cast("long").alias("score"), "k", "l", "r", "a")).alias("_best"))
    best = best.select("p", "_best.a", "_best.l", "_best.r", "_best.score")

    spans = F.expr(
        "flatten(transform(sequence(2, size(p) - 1), m -> transform(sequence(1, size(p) - m + 1), i -> slice(p, i, m))))"
    )
    longer = candidates.filter(F.size("p") > 2).select(F.explode(spans).alias("p"), F.col("a").alias("_longer"))
    longer = longer.groupBy("p").agg(F.max("_longer").alias("_longer"))
    covered = (100 * _wide("_longer") >= COVERS * _wide("a")) & F.col("_longer").isNotNull()
    left = best.join(longer, "p", "left").filter(~F.coalesce(covered, F.lit(False))).drop("_longer")

    keyed = left.select("p", F.posexplode("p").alias("at", "key")).join(phrases.words.select("key", "lang", "word"), "key")
    texts = keyed.groupBy("p").agg(
        F.first("lang").alias("lang"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"),
    )
    rows = left.join(texts, "p").join(phrases.totals, "lang")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents),
pc AS (SELECT lang, unnest(string_split_regex(x, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda t: t <> '') AS ws FROM pc),
totals AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
g AS (
  SELECT lang, k, array_to_string(ws[i : i + k - 1], ' ') AS phrase
  FROM w, unnest(range(1, 5)) AS t(k), unnest(range(1, greatest(len(ws) - k + 2, 1))) AS s(i)),
f AS (SELECT lang, k AS size, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE size > 1),
cut AS (
  SELECT lang, phrase, size, a, k, array_to_string(ws[1 : k], ' ') AS lp, array_to_string(ws[k + 1 : size], ' ') AS rp
  FROM c, unnest(range(1, size)) AS t(k)),
scored AS (
  SELECT cut.*, l.a AS l, r.a AS r, ((2000000::HUGEINT * cut.a) // (l.a + r.a))::BIGINT AS score
  FROM cut JOIN f l ON l.lang = cut.lang AND l.phrase = lp JOIN f r ON r.lang = cut.lang AND r.phrase = rp),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_ AS (
  SELECT lang, array_to_string(ws[i : i + m - 1], ' ') AS phrase, max(a) AS longer
  FROM c, unnest(range(2, size)) AS t(m), unnest(range(1, size - m + 2)) AS s(i) GROUP BY ALL),
kept AS (
  SELECT b.* FROM best b LEFT JOIN inner_ i ON i.lang = b.lang AND i.phrase = b.phrase
  WHERE i.longer IS NULL OR 100::HUGEINT * i.longer < 80::HUGEINT * b.a)
SELECT kept.lang, row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN totals USING (lang) QUALIFY rank <= 2000
"""


@query("op11_phrase_quicksort", ORACLE)
def op11_phrase_quicksort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(count_phrases(documents(spark, sf_dir)))
