"""Periodic runs of words: maximal stretches that repeat with a smallest period, at least twice.

A run is found from its Lyndon root. For both orders of the words, the longest Lyndon word that
starts at each place comes from the grouping phase of a suffix sorter: suffixes stand in groups by
a common beginning, and going from the greatest group down, every suffix that a group's members
follow (their nearest place before them in a lower group) takes that group's beginning to its own
and moves to a group just above its old one. When all groups are done, the length of each
beginning is that of the longest Lyndon word. Each such word, taken as a period, is carried on in
both directions as far as words one period apart are equal; that is a run if it is long enough.

The work goes over the places that can lie in a run only. A run of at least ``M`` words with a
period of at most half its length is covered by windows of ``M // 2`` words that occur again in the
text (each window of its first part occurs a period later), so places that no repeated window
covers lie in no run, and stretches of covered places are independent of each other. Windows are
compared by 64-bit hashes; equal ones hash alike, so none is missed, and one taken in error costs
time alone. Extensions compare exact names of ranges of 1, 2, 4, ... words.

A text lies in one task, with about 25 bytes of memory a byte of text and 300 bytes a word in
covered stretches. Words are runs of bytes outside ``\\x20`` and ``\\x09-\\x0D``, compared as they are.
Null and empty texts have no words and no runs, and their collapsed text is empty. Rows are worked
on one by one, so null ids and repeated rows have their own results. An empty table gives no rows.
New columns get names that no column of the input has.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwright.llm import words as W
from panelwright.llm.common import WORD, documents, fresh, query

MIN_LENGTH = 12


def lyndon_lengths(ranks: np.ndarray, low: int = 0) -> np.ndarray:
    """Length of the longest Lyndon word from each place, by grouping suffixes.

    ``ranks`` are not negative. Places of rank 0, of which there are ``low``, are ends between
    texts: smaller than all words and not worked out (their length is 1).
    """
    n = len(ranks)
    order = np.argsort(ranks, kind="stable")
    held = ranks[order]
    first = np.searchsorted(held, held)  # where each place's group begins
    begin = np.empty(n, np.int64)
    begin[order] = first
    where = np.empty(n, np.int64)
    where[order] = np.arange(n)
    sizes = np.bincount(first, minlength=n)
    suffixes, place, group, size = order.tolist(), where.tolist(), begin.tolist(), sizes.tolist()
    length, before = [1] * n, [-1] * n
    end = n
    while end > low:
        own = group[suffixes[end - 1]]
        members = suffixes[own:end]
        if end - own > 1:
            members.sort()
        step = length[members[0]]
        end = own
        followed: dict[int, int] = {}
        for i in members:
            j = i - 1
            while j >= 0 and group[j] >= own:
                j = before[j]
            before[i] = j
            if j >= 0 and group[j] >= low:
                followed[j] = followed.get(j, 0) + 1
        if not followed:
            continue
        times = set(followed.values())
        for k in sorted(times, reverse=True):
            # those that k members follow in a row stand above those with fewer
            moved: dict[int, list[int]] = {}
            for j, count in followed.items():
                if count != k:
                    continue
                length[j] += k * step
                old = group[j]
                last = old + size[old] - 1
                at, other = place[j], suffixes[last]
                suffixes[at], suffixes[last] = other, j
                place[other], place[j] = at, last
                size[old] -= 1
                if old in moved:
                    moved[old].append(j)
                else:
                    moved[old] = [j]
            for old, js in moved.items():
                new = old + size[old]
                size[new] = len(js)
                for j in js:
                    group[j] = new
    return np.array(length, np.int64)


def _names(ids: np.ndarray, longest: int) -> list[np.ndarray]:
    """Names of the ranges of 1, 2, 4, ... up to ``longest`` items from each place; equal ranges have equal names."""
    out = [ids.astype(np.int64)]
    width = 1
    while 2 * width <= longest:
        last = out[-1]
        n = len(last) - width
        pair = last[:n] * (int(last.max()) + 1) + last[width : width + n]
        out.append(np.unique(pair, return_inverse=True)[1])
        width *= 2
    return out


def _extend(names: list[np.ndarray], a: np.ndarray, b: np.ndarray, back: bool) -> np.ndarray:
    """How many items from ``a`` and ``b`` on (or, going back, before them) are equal."""
    found = np.zeros(len(a), np.int64)
    for level in range(len(names) - 1, -1, -1):
        own, width = names[level], 1 << level
        while True:
            # the longest width may fit more than once; all others once at most
            x, y = (a - found - width, b - found - width) if back else (a + found, b + found)
            fits = np.flatnonzero((x >= 0) & (y < len(own)) & (x < len(own)) & (y >= 0))
            same = fits[own[x[fits]] == own[y[fits]]]
            found[same] += width
            if level < len(names) - 1 or not len(same):
                break
    return found


def runs_of(ids: np.ndarray, ends: np.ndarray, min_length: int) -> np.ndarray:
    """Rows (start, length, period) of all runs in ``ids``, whose places ``ends`` separate texts.

    Items at ``ends`` are -1, others are not negative. Starts count from the beginning of ``ids``.
    """
    inner = ids >= 0
    ranks = np.zeros(len(ids), np.int64)
    known, ranks[inner] = np.unique(ids[inner], return_inverse=True)
    ranks[inner] += 1
    turned = np.where(inner, len(known) + 1 - ranks, 0)
    own = ranks.copy()
    own[~inner] = len(known) + 1 + np.arange(len(ends))  # no two ends are equal
    gaps = np.diff(np.concatenate([[-1], ends, [len(ids)]]))
    names = _names(own, int(gaps.max()) // 2 + 1)
    at = np.flatnonzero(inner)
    out = []
    for order in (ranks, turned):
        period = lyndon_lengths(order, len(ends))[at]
        right = _extend(names, at, at + period, False)
        left = _extend(names, at, at + period, True)
        whole = left + period + right
        run = np.flatnonzero(whole >= np.maximum(2 * period, min_length))
        out.append(np.stack([at[run] - left[run], whole[run], period[run]], 1))
    both = np.concatenate(out)
    return np.unique(both, axis=0) if len(both) else both


def covered(ids: np.ndarray, first: np.ndarray, width: int) -> np.ndarray:
    """Which items lie in a window of ``width`` items that occurs again in their text."""
    at = W.runs(first, width)
    out = np.zeros(len(ids) + 1, np.int64)
    if not len(at):
        return out[:-1] > 0
    text = np.searchsorted(first, at, "right")
    hashes = W.shingle_hashes(W.mix(ids.astype(np.uint64)), at, width)
    hashes = W.mix(hashes + text.astype(np.uint64) * np.uint64(W._BASE))
    order = np.argsort(hashes)
    ranked = hashes[order]
    same = ranked[1:] == ranked[:-1]
    twice = np.zeros(len(at), bool)
    twice[1:] |= same
    twice[:-1] |= same
    hit = at[order[twice]]
    np.add.at(out, hit, 1)
    np.add.at(out, hit + width, -1)
    return np.cumsum(out[:-1]) > 0


def text_runs(ids: np.ndarray, first: np.ndarray, min_length: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows (start, length, period) of the runs of all texts, counted from the first item of all, and
    where each text's rows begin. ``first`` has where each text's items begin, and the end."""
    inside = covered(ids, first, max(min_length // 2, 1))
    edge = np.zeros(len(ids) + 1, bool)
    edge[first] = True
    begins = np.flatnonzero(inside & (edge[:-1] | ~np.concatenate([[False], inside[:-1]])))
    stops = np.flatnonzero(inside & (edge[1:] | ~np.concatenate([inside[1:], [False]]))) + 1
    wide = stops - begins >= min_length
    begins, stops = begins[wide], stops[wide]
    found = np.zeros((0, 3), np.int64)
    if len(begins):
        sizes = stops - begins
        upto = np.cumsum(sizes + 1)
        ends = upto - 1
        shift = begins - (upto - sizes - 1)  # from a place in the joined stretches to its own
        joined = np.full(int(upto[-1]), -1, np.int64)
        inner = np.ones(len(joined), bool)
        inner[ends] = False
        joined[inner] = ids[np.repeat(shift, sizes) + np.flatnonzero(inner)]
        found = runs_of(joined, ends, min_length)
        found[:, 0] += shift[np.searchsorted(ends, found[:, 0])]
    found = found[np.lexsort((found[:, 2], found[:, 0]))]
    return found, np.searchsorted(found[:, 0], first)


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The words of some texts as one array of bytes, and the index of each text's first word."""
    space = W._SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begins = ~space
    begins[1:] &= space[:-1] | edge[1:-1]
    begin = np.flatnonzero(begins)
    letters = np.cumsum(~space)
    starts = (letters[begin] - 1) if len(begin) else np.zeros(0, np.int64)
    bounds = np.concatenate([starts, letters[-1:]]).astype(np.int64) if len(begin) else np.zeros(1, np.int64)
    held = data[~space]
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(bounds), pa.py_buffer(held)])
    return words, np.searchsorted(begin, offsets)


def _joined(words: pa.Array, first: np.ndarray) -> pa.Array:
    """Texts of words with one space between; ``first`` has each text's first word, and the end."""
    n = len(words)
    bounds = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + n + 1]
    data = np.frombuffer(words.buffers()[2], np.uint8)[bounds[0] : bounds[-1]] if n else np.zeros(0, np.uint8)
    opens = np.zeros(n, np.int64)
    opens[first[:-1][np.diff(first) > 0]] = 1
    spaces = np.arange(1, n + 1) - np.cumsum(opens)  # spaces up to each word: one before all but a text's first
    sizes = np.diff(bounds)
    out = np.full(len(data) + (int(spaces[-1]) if n else 0), 0x20, np.uint8)
    if n:
        out[np.arange(len(data)) + np.repeat(spaces, sizes)] = data
    ends = np.concatenate([[0], bounds[1:] - bounds[0] + spaces]) if n else np.zeros(1, np.int64)
    offsets = ends[first]
    return pa.LargeStringArray.from_buffers(len(first) - 1, pa.py_buffer(offsets), pa.py_buffer(out))


def _collapse(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of ``n`` items stay when every run keeps its first period alone."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edges, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edges[:-1]) == 0


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_RUNS = "array<struct<start:long,length:long,period:long>>"


def find_runs(docs: DataFrame, text_column: str = "text", min_length: int = MIN_LENGTH) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with ``runs`` (start, length, period of each, in order of start, then period) and
    ``collapsed`` (the words that no run holds after its first period), and the column each is in."""
    names = {x: fresh(docs, x) for x in ("runs", "collapsed")}
    schema = T.StructType(docs.schema.fields + T._parse_datatype_string(f"`{names['runs']}` {_RUNS}, `{names['collapsed']}` string").fields)
    text_at = docs.columns.index(text_column)

    def work(texts: pa.Array):
        data, offsets = W.text_bytes(texts)
        at, n = 0, len(offsets) - 1
        while at < n:
            end = int(np.searchsorted(offsets, offsets[at] + W.CHUNK_BYTES, "right")) - 1
            end = min(max(end, at + 1), n)
            low = offsets[at]
            words, first = _words(data[low : offsets[end]], offsets[at : end + 1] - low)
            ids = words.dictionary_encode().indices.to_numpy(zero_copy_only=False)
            runs, rows = text_runs(ids, first, min_length)
            collapsed, starts = words, first
            if len(runs):
                stays = _collapse(len(ids), runs)
                collapsed = words.take(pa.array(np.flatnonzero(stays)))
                starts = np.concatenate([[0], np.cumsum(stays)])[first]
            own = runs.copy()
            own[:, 0] -= np.repeat(first[:-1], np.diff(rows))
            lists = pa.ListArray.from_arrays(
                pa.array(rows, pa.int32()), pa.StructArray.from_arrays([pa.array(own[:, k]) for k in range(3)], fields=list(_RUN))
            )
            yield at, end, lists, _joined(collapsed, starts).cast(pa.string())
            at = end

    def run(batches):
        for batch in batches:
            for a, b, runs, collapsed in work(batch.column(text_at)):
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(a, b - a).columns, runs, collapsed], names=[*batch.schema.names, *names.values()]
                )

    return docs.mapInArrow(run, schema), names


def planted(doc_id: Column, text: Column) -> Column:
    """The text, in every tenth document made periodic from some word on; as it is where the id is null."""
    h = F.crc32(doc_id.cast("string").cast("binary"))

    def periodic(words: Column) -> Column:
        g, n = F.floor(h / 10), F.size(words).cast("long")
        a = g % F.greatest(n, F.lit(1))
        p = 1 + F.floor((n - a) / (3 + g % 8))

        def word(i: Column, bounds: Column) -> Column:
            a, p = bounds["a"], bounds["p"]
            return F.get(words, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))

        numbers = F.sequence(F.lit(0).cast("long"), n - 1)
        made = F.transform(
            F.array(F.struct(a.alias("a"), p.alias("p"))),
            lambda bounds: F.array_join(F.transform(numbers, lambda i: word(i, bounds)), " "),
        )
        return F.when(n > 0, F.get(made, F.lit(0))).otherwise(text)

    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return F.when(h % 10 == 0, F.get(F.transform(F.array(words), periodic), F.lit(0))).otherwise(text)


@query("op13_lyndon_runs")
def op13_lyndon_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text"))
    found, at = find_runs(docs)
    runs = F.col(at["runs"])
    best = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    rows = found.select("doc_id", F.size(runs).cast("long").alias("n_runs"), best.alias("_best"), lines.alias("_lines"), F.col(at["collapsed"]).alias("_rest"))
    return rows.select(
        "doc_id",
        "n_runs",
        (-F.col("_best.s")).alias("start"),
        F.col("_best.length").alias("length"),
        (-F.col("_best.p")).alias("period"),
        F.floor(1000 * F.col("_best.length") / -F.col("_best.p")).alias("exponent_milli"),
        F.sha2(F.array_join("_lines", ""), 256).alias("runs_sha256"),
        F.sha2(F.col("_rest"), 256).alias("collapsed_sha256"),
    )
