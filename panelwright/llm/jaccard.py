"""N-gram Jaccard join: count-vector R-trees, bounds by summed coordinate minima, exact check.

A document's set are its distinct word shingles. Shingles are hashed into groups and the counts
of the groups are a point. The overlap of two sets is at most the sum of the minima of their
coordinates, and the same holds for a box: the sum of the minima of a point's coordinates and the
box's upper corner bounds the overlap with everything in it. Pairs that survive the bound are
verified on the whole sets, so the result has exactly the links with
``100 * intersection >= percent * union``. Words in a shingle and percent are parameters; their
defaults are those of the query.

Boxes of random counts overlap too much to keep far nodes of one huge tree apart, so the root
fans out first: sets that reach the similarity share one of their few rarest shingles (the prefix
filter), and below each such shingle there is one tree. Points are packed into leaves in the order
of a space-filling curve through eight coarse sums of their counts, so that like points share a
leaf, and leaves into nodes until a branch has few of them. The tree meets itself from the top
down: pairs of boxes whose bound allows no link are dropped before their children are looked at,
and points are compared only in pairs of leaves that are left. A shingle counts as rarer
the less its words occur in all documents, by a count table of fixed size; any order gives the same
result. Equal sets
are one point. Very common shingles order last, so they are rarely a root. Only the connected
groups are asked for, so some rounds link the points below a root to one pivot where that is right,
and the trees then search for links between all points not connected yet: thousands of near copies
need no pairs among themselves.

Lower case means A-Z. A text with fewer words than a shingle is one shingle of all of them. A null,
empty or blank text has the empty set, is linked with nothing and forms its own group. Rows with
the same set are linked. A null id counts as the largest one: a group's id is null only if all
its ids are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.llm import shared_files
from panelwright.llm import words as W
from panelwright.llm.common import documents, forget, fresh, own_folder, query, release
from panelwright.llm.common import settle as settle_wide
from panelwright.llm.components import components, near_roots, stars
from panelwright.staging import batch_bytes, parquet_codec, remove

#: Words of a shingle and least similarity of the query.
SHINGLE = 3
PERCENT = 90
GROUPS = 256
#: Slots of the table of word counts.
SLOTS = 1 << 18
_BLOCK = 1 << 12
#: Points of a leaf, and the power of two of the children of an inner node.
LEAF = 64
FAN_BITS = 4
#: Coarse sums the packing order follows, and bits of each.
COARSE, COARSE_BITS = 8, 3
#: Rounds with one pivot for each branch, or each size in it, before the trees are searched for all
#: that is left.
PIVOT_ROUNDS = 4
#: Where connected groups have more points, one pair of each two groups in each leaf is tried before the
#: trees are searched for all pairs: else each point such a group lacks is met by each of its points.
LARGE = 64
#: A further round of either kind is taken while one links at least this share of what all did so far.
WORTH = 8
#: Bytes that go to a Python worker at once: leaves and whole sets are wide rows.
BATCH_BYTES = 8 << 20
#: Pairs of leaves of a cell that are opened at once.
_CELL_PAIRS = 64
#: Counts from here on are taken as without limit, which keeps bounds right.
FULL = (1 << 8) - 1


def settle(df: DataFrame) -> DataFrame:
    """Writes ``df``, with small batches to Python workers; counts are small numbers, which zstd packs best."""
    with batch_bytes(df.sparkSession, BATCH_BYTES), parquet_codec(df.sparkSession, "zstd"):
        return settle_wide(df)


def sets(w: W.Words, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, where each text's begin, and the first word
    of each."""
    h = w.hashes()
    at = W.runs(w.first, k)
    value, of = W.shingle_hashes(h, at, k), w.text_of[at]
    counts = w.counts
    for few in range(1, k):
        short = np.flatnonzero(counts == few)
        value = np.concatenate([value, W.shingle_hashes(h, w.first[short], few)])
        of = np.concatenate([of, short])
        at = np.concatenate([at, w.first[short]])
    values, starts, index = W.regroup(of, value, w.texts)
    return values, starts, at[index]


def _slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(SLOTS - 1)).astype(np.int64)


def _count_slots(batches):
    table = np.zeros(SLOTS, np.int64)
    for batch in batches:
        for _, _, w in W.chunks(batch.column(0), True):
            table += np.bincount(_slot(w.hashes()), minlength=SLOTS)
    blocks = table.reshape(-1, _BLOCK)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.arange(len(blocks), dtype=np.int32)), pa.array([b.tobytes() for b in blocks], pa.binary())],
        names=["block", "counts"],
    )


def _add_blocks(table: pa.Table) -> pa.Table:
    total = np.zeros(_BLOCK, np.int64)
    for x in table["counts"]:
        total += np.frombuffer(x.as_buffer(), np.int64)
    return pa.table(
        {"block": pa.array([table["block"][0].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())}
    )


def rarity(texts: DataFrame) -> np.ndarray:
    """For each slot the power of two of how often its words occur, in all documents.

    A task sends its table in blocks, whatever it read; blocks are added in two steps.
    """
    kind = "block int, counts binary"
    parts = texts.mapInArrow(_count_slots, kind).withColumn("part", F.spark_partition_id() % 64)
    once = parts.groupBy("block", "part").applyInArrow(_add_blocks, kind)
    rows = once.groupBy("block").applyInArrow(_add_blocks, kind).toArrow()
    table = np.zeros((SLOTS // _BLOCK, _BLOCK), np.int64)
    for block, counts in zip(rows["block"].to_pylist(), rows["counts"].to_pylist()):
        table[block] = np.frombuffer(counts, np.int64)
    return np.log2(np.maximum(table.ravel(), 1)).astype(np.uint64)


def least_common(size: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Shingles that a set shares at least with any set as similar as asked for."""
    return -(-percent * size // 100)


def _class_ids(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of each whole set; 0 for the empty one."""
    n = np.diff(at)
    full = np.flatnonzero(n)
    cid = np.zeros(len(n), np.uint64)
    if len(full):
        total = np.add.reduceat(W.mix(values), at[full])
        other = np.bitwise_xor.reduceat(values, at[full])
        cid[full] = W.mix(total ^ W.mix(other + n[full].astype(np.uint64)))
    return cid


def _curve(counts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Each point's place on a curve through coarse sums of its counts, in standard deviations from
    what its size lets expect. It only decides which points share a leaf."""
    coarse = counts.reshape(-1, COARSE, GROUPS // COARSE).sum(axis=2, dtype=np.int64)
    expected = np.maximum(n[:, None] / COARSE, 1e-9)
    half = 1 << (COARSE_BITS - 1)
    cell = np.clip(np.floor((coarse - expected) / np.sqrt(expected)) + half, 0, 2 * half - 1).astype(np.int64)
    place = np.zeros(len(n), np.int64)
    for bit in range(COARSE_BITS - 1, -1, -1):
        for i in range(COARSE):
            place = place << 1 | cell[:, i] >> bit & 1
    return place


def _sketch(order: np.ndarray, k: int, percent: int):
    """Rows ``_id, _row, n, cid, counts, curve, roots`` of texts."""

    def one(w: W.Words) -> list[pa.Array]:
        values, at, word = sets(w, k)
        n = np.diff(at)
        of = np.repeat(np.arange(w.texts), n)
        cid = _class_ids(values, at)
        group = (values >> np.uint64(40)).astype(np.int64) % GROUPS
        counts = np.bincount(of * GROUPS + group, minlength=w.texts * GROUPS).clip(max=FULL).astype(np.uint8)
        common = order[_slot(w.hashes())]
        last = np.minimum(word + k, w.first[of + 1]) - 1
        level = sum(common[np.minimum(word + i, last)] for i in range(k))
        rank = (np.minimum(level, np.uint64(255)) << np.uint64(56)) | (values >> np.uint64(8))
        by = W.order_within(of, rank)
        place = np.arange(len(values)) - np.repeat(at[:-1], n)
        roots = np.where(n > 0, n - least_common(n, percent) + 1, 0)
        chosen = values[by][place < np.repeat(roots, n)]
        ends = np.zeros(w.texts + 1, np.int32)
        np.cumsum(roots, out=ends[1:])
        return [
            pa.array(n.astype(np.int64)),
            pa.array(cid.view(np.int64)),
            _narrow(counts.reshape(-1, GROUPS)),
            pa.array(_curve(counts, n)),
            pa.ListArray.from_arrays(pa.array(ends), pa.array(chosen.view(np.int64))),
        ]

    def run(batches):
        for batch in batches:
            for a, b, w in W.chunks(batch.column(2), True):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), *one(w)], names=["_id", "_row", "n", "cid", "counts", "curve", "roots"]
                )

    return run


def _branches(full: DataFrame, percent: int) -> DataFrame:
    """``root, band, cid, n``: the points below each root, in bands of size, where they aren't alone.

    Two sets can only be linked if their sizes are in one band or in neighbouring ones, so each
    point is in its own band and in the next.
    """
    below = full.select("cid", "n", F.explode("roots").alias("root"))
    ends = [F.min("cid").alias("lo"), F.max("cid").alias("hi")]
    shared = below.groupBy("root").agg(*ends).filter("lo <> hi").select("root")
    band = F.floor(F.log("n") / F.log(F.lit(100 / percent)) + 1e-9)
    both = below.join(shared, "root").select("root", "cid", "n", F.explode(F.array(band, band + 1)).alias("band")).distinct()
    both = settle(both)
    busy = both.groupBy("root", "band").agg(*ends).filter("lo <> hi").select("root", "band")
    tree = settle(both.join(busy, ["root", "band"]))
    release(both)
    return tree


def _ceil_need(na: np.ndarray, nb: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Least overlap at which sets of these sizes are linked."""
    both = na.astype(np.int64) + nb
    return -(-percent * both // (100 + percent))


def _narrow(counts: np.ndarray) -> pa.Array:
    """Rows of counts as bytes: two counts a byte where all of a row are below 16, else one."""
    small = counts.max(axis=1, initial=0) < 16
    halves = counts[:, 0::2] | counts[:, 1::2] << 4
    return pa.array([(halves[i] if few else counts[i]).tobytes() for i, few in enumerate(small)], pa.binary())


def _points(column: pa.Array) -> np.ndarray:
    """Rows of counts from bytes of either width."""
    data, at = W.text_bytes(column.cast(pa.large_binary()).view(pa.large_string()))
    out = np.empty((len(column), GROUPS), np.uint8)
    half = np.diff(at) < GROUPS
    for rows, width in ((np.flatnonzero(half), GROUPS // 2), (np.flatnonzero(~half), GROUPS)):
        found = data[at[rows][:, None] + np.arange(width)]
        if width == GROUPS:
            out[rows] = found
        else:
            out[rows, 0::2], out[rows, 1::2] = (found & 15), (found >> 4)
    return out


def _bound(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sums of coordinate minima of rows of counts; without limit where both counts are FULL."""
    least = np.minimum(x, y)
    return least.sum(axis=1, dtype=np.int64) + (least == FULL).any(axis=1) * (1 << 40)


def _bounded_pairs(percent: int):
    """Of pairs of points, those whose bound allows a link."""

    def run(batches):
        for batch in batches:
            na, nb = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
            most = _bound(_points(batch.column("ca")), _points(batch.column("cb")))
            yield batch.filter(pa.array(most >= _ceil_need(na, nb, percent))).select(["a", "b"])

    return run


def _pack(leaf: int):
    """Leaves of consecutive points below one root, their boxes and their numbers in this order."""

    def run(batches):
        task = TaskContext.get().partitionId() << 32
        for batch in batches:
            if not batch.num_rows:
                continue
            root, band = batch.column("root").to_numpy(), batch.column("band").to_numpy()
            fresh_root = np.flatnonzero(np.append(True, (root[1:] != root[:-1]) | (band[1:] != band[:-1])))
            ends = np.append(fresh_root[1:], len(root))
            cuts = [(s, min(s + leaf, e)) for a, e in zip(fresh_root, ends) for s in range(a, e, leaf)]
            cid, n, comp = (batch.column(c).to_numpy() for c in ("cid", "n", "comp"))
            points = _points(batch.column("counts"))
            out = [
                (
                    root[s],
                    band[s],
                    task + i,
                    int(n[s:e].min()),
                    int(n[s:e].max()),
                    int(comp[s:e].min()),
                    int(comp[s:e].max()),
                    points[s:e].max(axis=0).tobytes(),
                    cid[s:e].tobytes() + n[s:e].tobytes() + comp[s:e].tobytes() + points[s:e].tobytes(),
                )
                for i, (s, e) in enumerate(cuts)
            ]
            task += len(cuts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(zip(*out), [pa.int64()] * 7 + [pa.binary()] * 2)],
                names=["root", "band", "node", "n_lo", "n_hi", "comp_lo", "comp_hi", "corner", "points"],
            )

    return run


_NODE_KIND = "root long, band long, node long, n_lo long, n_hi long, comp_lo long, comp_hi long, corner binary"


def _open(blob: bytes) -> tuple[np.ndarray, ...]:
    n = len(blob) // (24 + GROUPS)
    whole = np.frombuffer(blob[: 24 * n], np.int64).reshape(3, n)
    return *whole, np.frombuffer(blob[24 * n :], np.uint8).reshape(n, GROUPS)


def _box(bits: int):
    """The node above some nodes of a branch."""
    names = [x.split()[0] for x in _NODE_KIND.split(", ")]

    def run(table: pa.Table) -> pa.Table:
        least, most = (lambda c: pc.min(table[c]).as_py()), (lambda c: pc.max(table[c]).as_py())
        corner = _points(table["corner"].combine_chunks()).max(axis=0).tobytes()
        key = [table[c][0].as_py() for c in ("root", "band", "node")]
        row = [*key[:2], key[2] >> bits, least("n_lo"), most("n_hi"), least("comp_lo"), most("comp_hi"), corner]
        return pa.table([pa.array([x], pa.binary() if c == "corner" else pa.int64()) for x, c in zip(row, names)], names=names)

    return run


def _levels(leaves: DataFrame, bits: int) -> list[DataFrame]:
    """Nodes of the trees, leaves first: branches with more than a node's children get another level.

    Numbers of nodes of one branch that different tasks packed stay apart, so a branch may keep as
    many top nodes as tasks packed it.
    """
    levels = [leaves.drop("points")]
    most = None
    while True:
        size = levels[-1].groupBy("root", "band").agg(F.count("*").alias("nodes")).filter(F.col("nodes") > 1 << bits)
        now = size.agg(F.max("nodes")).first()[0]
        if now is None or (most is not None and now >= most):
            return levels
        most = now
        wide = levels[-1].join(size.select("root", "band"), ["root", "band"]).select(*levels[-1].columns)
        up = F.shiftright("node", bits)
        levels.append(settle(wide.groupBy("root", "band", up.alias("up")).applyInArrow(_box(bits), _NODE_KIND)))


def _boxes_meet(percent: int):
    """Of pairs of nodes, those that may hold a link: a node with itself, or by their boxes."""

    def run(batches):
        for batch in batches:
            a, b, na, nb = (batch.column(c).to_numpy() for c in ("node_a", "node_b", "n_lo_a", "n_lo_b"))
            most = _bound(_points(batch.column("corner_a")), _points(batch.column("corner_b")))
            keep = (a == b) | (most >= _ceil_need(na, nb, percent))
            yield batch.filter(pa.array(keep)).select(["root", "band", "node_a", "node_b"])

    return run


def _meeting_leaves(levels: list[DataFrame], percent: int, bits: int) -> DataFrame:
    """``root, band, node_a, node_b``: pairs of different leaves of a branch whose boxes, and those of
    all nodes above them, allow a link between points that aren't connected."""
    by = ["root", "band"]
    pairs = None
    for depth in range(len(levels) - 1, -1, -1):
        level = levels[depth]
        a, b = (
            level.select(*by, *[F.col(c).alias(f"{c}_{x}") for c in level.columns[2:]]).withColumn(
                f"up_{x}", F.shiftright(f"node_{x}", bits)
            )
            for x in "ab"
        )
        top = a if depth + 1 == len(levels) else a.join(levels[depth + 1].select(*by).distinct(), by, "left_anti")
        # few nodes of a branch without a level above, then children of the pairs that met above
        both = top.join(b, by)
        if pairs is not None:
            above = pairs.select(*by, F.col("node_a").alias("up_a"), F.col("node_b").alias("up_b"))
            below = above.join(a, [*by, "up_a"]).join(b, [*by, "up_b"])
            both = both.unionByName(below.select(*both.columns))
        order = "<=" if depth else "<"
        both = both.filter(
            f"node_a {order} node_b and 100 * n_hi_a >= {percent} * n_lo_b and 100 * n_hi_b >= {percent} * n_lo_a "
            "and not (comp_lo_a = comp_hi_a and comp_lo_b = comp_hi_b and comp_lo_a = comp_lo_b)"
        )
        asked = both.select(*by, "node_a", "node_b", "n_lo_a", "n_lo_b", "corner_a", "corner_b")
        met = settle(asked.mapInArrow(_boxes_meet(percent), "root long, band long, node_a long, node_b long"))
        release(pairs)
        pairs = met
    return pairs


def _best(pairs: np.ndarray, most: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Of pairs of points the one with the highest bound for each pair of their groups."""
    order = np.lexsort((pairs[1], pairs[0], -most))
    _, first = np.unique(of[:, order], axis=1, return_index=True)
    return pairs[:, order[first]]


def _search(percent: int, thin: bool = False):
    """Pairs of points of two leaves that aren't connected and whose bound allows a link; ``thin``: of
    each two groups only the pair with the highest bound."""

    def run(batches):
        for batch in batches:
            found: list[np.ndarray] = [np.zeros((2, 0), np.int64)]
            for x, y, box in zip(batch.column("points_a"), batch.column("points_b"), batch.column("corner_b")):
                a, na, ka, pa_ = _open(x.as_py())
                b, nb, kb, pb = _open(y.as_py())
                corner = np.frombuffer(box.as_py(), np.uint8)
                # the box first: which points of one leaf can have a partner in the other at all
                reach = _bound(pa_, corner) >= least_common(na, percent)
                mine: list[tuple[np.ndarray, ...]] = []
                for i in np.flatnonzero(reach):
                    most = _bound(pb, pa_[i])
                    need = _ceil_need(na[i], nb, percent)
                    far = (kb != ka[i]) & (most >= need)
                    if far.any():
                        other = b[far]
                        pairs = np.stack([np.minimum(other, a[i]), np.maximum(other, a[i])])
                        if thin:
                            of = np.stack([np.minimum(kb[far], ka[i]), np.maximum(kb[far], ka[i])])
                            mine.append((pairs, (most - need)[far], of))
                        else:
                            found.append(pairs)
                if mine:
                    found.append(_best(*(np.concatenate(x, axis=-1) for x in zip(*mine))))
            both = np.unique(np.concatenate(found, axis=1), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["a", "b"])

    return run


def _search_cell(percent: int):
    """``_search`` for the pairs of leaves of one cell: two nodes' children, each of which is there once."""

    def run(pairs: pa.Table, leaves: pa.Table) -> pa.Table:
        at = {n: i for i, n in enumerate(leaves["node"].to_pylist())}
        a, b = (pa.array([at[n] for n in pairs[c].to_pylist()], pa.int64()) for c in ("node_a", "node_b"))
        points, corner = leaves["points"].combine_chunks(), leaves["corner"].combine_chunks()
        found = []
        for i in range(0, len(a), _CELL_PAIRS):
            x, y = a.slice(i, _CELL_PAIRS), b.slice(i, _CELL_PAIRS)
            batch = pa.RecordBatch.from_arrays(
                [points.take(x), points.take(y), corner.take(y)], names=["points_a", "points_b", "corner_b"]
            )
            found += _search(percent)([batch])
        return pa.Table.from_batches(found)

    return run


def _across(leaves: DataFrame, meet: DataFrame, percent: int, bits: int) -> DataFrame:
    """``a, b``: pairs of points of the leaves that meet. A leaf goes to each cell of two parents' children
    that it has a pair in, not along with each pair: leaves of near copies meet many others."""
    cell = ["root", "band", "up_a", "up_b"]
    dealt = meet.withColumns({f"up_{x}": F.shiftright(f"node_{x}", bits) for x in "ab"})
    wanted = dealt.select(*cell, F.explode(F.array("node_a", "node_b")).alias("node")).distinct()
    there = leaves.select("root", "band", "node", "points", "corner")
    own = [f"own_{c}" for c in cell]  # both sides come from one table
    held = wanted.join(there, ["root", "band", "node"]).select(*cell, "node", "points", "corner").toDF(*own, "node", "points", "corner")
    pairs = dealt.select(*cell, "node_a", "node_b").groupBy(*cell)
    return pairs.cogroup(held.groupBy(*own)).applyInArrow(_search_cell(percent), "a long, b long")


def _tree_pairs(
    labelled: DataFrame, points: DataFrame, percent: int, leaf: int = LEAF, bits: int = FAN_BITS, thin: bool = False
) -> DataFrame:
    """``a, b``: the pairs the trees find between points of different ``comp``; ``thin``: one of each
    two groups in each leaf, which takes work in proportion to the points."""
    order = ["root", "band", "curve", "cid"]
    placed = labelled.join(points.drop("n"), "cid").select("root", "band", "cid", "n", "comp", "counts", "curve")
    sorted_ = placed.repartitionByRange(*order).sortWithinPartitions(*order)
    leaves = settle(sorted_.mapInArrow(_pack(leaf), f"{_NODE_KIND}, points binary"))
    inner = leaves.filter("comp_lo <> comp_hi").selectExpr("points as points_a", "points as points_b", "corner as corner_b")
    if thin:
        pairs = settle(inner.mapInArrow(_search(percent, thin), "a long, b long").distinct())
        release(leaves)
        return pairs
    levels = _levels(leaves, bits)
    meet = _meeting_leaves(levels, percent, bits)
    within = inner.mapInArrow(_search(percent), "a long, b long")
    pairs = settle(within.union(_across(leaves, meet, percent, bits)).distinct())
    release(leaves, meet, *levels[1:])
    return pairs


def _write_sets(k: int, folder: str):
    """Each set of a task goes to its file once, with a row that says where; the same set may also come
    from another task."""

    def run(batches):
        sent: set[int] = set()
        stream, name, written = None, "", 0
        try:
            for batch in batches:
                for _, _, w in W.chunks(batch.column(0), True):
                    values, at, _ = sets(w, k)
                    cid = _class_ids(values, at)
                    new = [i for i, c in enumerate(cid.tolist()) if c not in sent and not sent.add(c)]
                    if stream is None and new:
                        stream, path = shared_files.create(folder, f"sets-{TaskContext.get().partitionId():05d}")
                        name = path.rpartition("/")[2]
                    n = np.diff(at)[new]
                    for i in new:
                        stream.write(values[at[i] : at[i + 1]].tobytes())
                    first = written + np.cumsum(n) - n
                    written += int(n.sum())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cid[new].view(np.int64)), pa.array([name] * len(new), pa.string()), pa.array(first), pa.array(n)],
                        names=["cid", "file", "first", "n"],
                    )
        finally:
            if stream is not None:
                stream.close()

    return run


def _verify(percent: int, folder: str):
    def run(batches):
        files: dict[str, shared_files.Numbers] = {}

        def members(file: str, first: int, n: int) -> np.ndarray:
            if file not in files:
                files[file] = shared_files.Numbers(shared_files.join(folder, file), np.uint64)
            return files[file].range(first, n)

        for batch in batches:
            good = []
            where = [batch.column(c).to_pylist() for c in ("file_a", "first_a", "n_a", "file_b", "first_b", "n_b")]
            for *x, file, first, n in zip(*where):
                s, t = members(*x), members(file, first, n)
                common = len(np.intersect1d(s, t, assume_unique=True))
                good.append(100 * common >= percent * (len(s) + len(t) - common))
            yield batch.filter(pa.array(good, pa.bool_())).select(["a", "b"])

    return run


def _linked(pairs: DataFrame, places: DataFrame, folder: str, percent: int) -> DataFrame:
    """The pairs of sets that are similar enough, by their whole sets. A pair travels with the places of
    its sets, not with the sets: long sets that the bound can't tell apart are in many pairs."""
    one = places.groupBy("cid").agg(F.min(F.struct("file", "first", "n")).alias("at"))
    both = pairs
    for x in "ab":
        both = both.join(one.select(F.col("cid").alias(x), *[F.col(f"at.{c}").alias(f"{c}_{x}") for c in ("file", "first", "n")]), x)
    # rows are short and their work is long, so their size must not decide how many tasks there are
    tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return both.repartition(tasks, "a", "b").mapInArrow(_verify(percent, folder), "a long, b long")


def groups(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = SHINGLE, percent: int = PERCENT
) -> DataFrame:
    """``_id``, ``_row``, ``n``, ``component`` for each row; ``_row`` is the hash of its text.

    Sets of runs of ``shingle`` words are linked from a similarity of ``percent`` on, below 100.
    """
    if shingle < 1 or not 0 < percent < 100:
        raise ValueError("a shingle has at least one word, and percent lies between 0 and 100")
    rows = docs.select(
        F.col(id_column).alias("_id"), F.xxhash64(text_column).alias("_row"), F.col(text_column).alias("text")
    )
    order = rarity(rows.select("text"))
    kind = (
        f"_id {docs.schema[id_column].dataType.simpleString()}, _row long, n long, cid long, "
        "counts binary, curve long, roots array<bigint>"
    )
    sketches = settle(rows.mapInArrow(_sketch(order, shingle, percent), kind))
    full = sketches.filter("n > 0")
    classes = settle(
        full.groupBy("cid").agg(
            F.min("_id").alias("least"),
            F.any_value("n").alias("n"),
            F.any_value("counts").alias("counts"),
            F.any_value("curve").alias("curve"),
            F.min("_row").alias("row"),
        )
    )
    points = classes.select("cid", "n", "counts", "curve")
    tree = _branches(full, percent)
    own = settle(sketches.select("_id", "_row", "n", "cid"))
    release(sketches)

    def linked(pairs: DataFrame) -> DataFrame:
        """The pairs whose whole sets are similar enough; the sets are read again from one text of each."""
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct()
        texts = settle(wanted.join(classes.select("cid", "row"), "cid").select(F.col("row").alias("_row")))
        found = rows.select("_row", "text").join(texts, "_row", "left_semi").select("text")
        folder = own_folder(docs.sparkSession, "sets")
        places = settle(found.mapInArrow(_write_sets(shingle, folder), "cid long, file string, first long, n long"))
        right = settle(_linked(pairs, places, folder, percent))
        release(texts, places)
        remove(docs.sparkSession, folder)
        return right

    # rounds against one pivot of each branch, another one each time
    links, known = None, []
    labelled, given = tree.withColumn("comp", F.col("cid")), None
    least_branch = 2

    def join(right: DataFrame, rounds: int) -> None:
        """Takes in links: the points get the labels they lead to, branches of one label or with less
        than ``least_branch`` points go."""
        nonlocal links, labelled, given
        before, links = links, stars(right if links is None else links.union(right), rounds)
        release(before, right)
        near_by = near_roots(links).toDF("cid", "label")
        named = tree.join(near_by, "cid", "left").select("root", "band", "cid", "n", F.coalesce("label", "cid").alias("comp"))
        spread = [F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("size")]
        apart = named.groupBy("root", "band").agg(*spread).filter(f"lo <> hi and size >= {least_branch}")
        before, given = given, settle(named.join(apart.select("root", "band"), ["root", "band"]))
        labelled = given
        release(before)
        forget(docs.sparkSession)

    def unasked(pairs: DataFrame, old: list[DataFrame]) -> DataFrame:
        for x in old:
            pairs = pairs.join(x, ["a", "b"], "left_anti")
        return pairs

    ends, so_far = points.drop("curve"), 0
    for turn in range(PIVOT_ROUNDS):
        pick = F.min_by(F.struct("cid", "n", "comp"), F.struct(F.xxhash64("cid", F.lit(turn)), "cid"))
        by = ["root", "band"] if turn % 2 else ["root", "n"]  # equal sizes first: near copies mostly are
        pivots = labelled.groupBy(*by).agg(pick.alias("p"))
        first = (
            labelled.join(pivots, by)
            .filter(f"p.comp <> comp and 100 * least(n, p.n) >= {percent} * greatest(n, p.n)")
            .select(F.least("p.cid", "cid").alias("a"), F.greatest("p.cid", "cid").alias("b"))
            .distinct()
        )
        first = unasked(first, known)
        sized = first.join(ends.toDF("a", "na", "ca"), "a").join(ends.toDF("b", "nb", "cb"), "b")
        near = settle(sized.select("a", "b", "na", "nb", "ca", "cb").mapInArrow(_bounded_pairs(percent), "a long, b long"))
        if near.isEmpty():
            break
        known.append(near)
        right = linked(near)
        now = right.count()
        if not now:
            break
        if turn % 2:
            least_branch = 3  # a branch of two points has one pair, and its pivot has just been asked for that
        join(right, 1)
        so_far += now
        if WORTH * now < so_far:
            break

    # then what large groups lack, as long as that links most of what it asks for
    while links is not None:
        large = near_roots(links).groupBy("root").count().filter(F.col("count") > LARGE).select(F.col("root").alias("comp"))
        busy = labelled.join(large, "comp", "left_semi").select("root", "band").distinct()
        dense = settle(labelled.join(busy, ["root", "band"], "left_semi"))
        if dense.isEmpty():
            release(dense)
            break
        thin = _tree_pairs(dense, points, percent, thin=True)
        release(dense)
        asked = settle(unasked(thin, known))
        release(thin)
        known.append(asked)
        right = linked(asked)
        now = right.count()
        so_far += now
        going = now > LARGE and WORTH * now >= so_far and 2 * now > asked.count()
        join(right, 2)
        if not going:
            break

    # then the trees, for what isn't connected yet
    found = _tree_pairs(labelled, points, percent)
    release(tree, given)
    forget(docs.sparkSession)
    pairs = unasked(found, known)
    if not pairs.isEmpty():
        right = linked(pairs)
        links = right if links is None else links.union(right)
    release(found, *known)
    if links is None:
        roots = classes.select("cid", F.col("cid").alias("label"))
    else:
        roots = components(links).toDF("cid", "label")

    named = classes.select("cid", "least").join(roots, "cid", "left").select(
        "cid", "least", F.coalesce("label", "cid").alias("label")
    )
    ids = named.groupBy("label").agg(F.min("least").alias("component"))
    by_class = named.join(ids, "label").select("cid", "component")
    return own.join(by_class, "cid", "left").select(
        "_id", "_row", "n", F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("_id")).alias("component"),
        F.when(F.col("n") > 0, F.col("cid")).alias("cid"),
    )


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS x FROM documents),
g AS (
  SELECT DISTINCT doc_id, CASE WHEN len(x) < 3 THEN array_to_string(x, ' ') ELSE x[i + 1] || ' ' || x[i + 2] || ' ' || x[i + 3] END AS s
  FROM w, unnest(range(0, greatest(len(x) - 2, 1))) AS t(i) WHERE len(x) > 0),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS c FROM r GROUP BY a) m ON m.a = d.doc_id
"""


def keep_one(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One document of each group: the one with the least id, with the columns it came with."""
    found = groups(docs, shingle=shingle, percent=percent)
    order = F.struct(F.col("_id").isNull(), "_id", "_row")
    alone = found.filter("n = 0").select("_id", "_row")
    best = (
        found.filter("n > 0")
        .withColumn("_alone", F.when(F.col("component").isNull(), F.col("cid")))
        .groupBy("component", "_alone")
        .agg(F.min(order).alias("best"))
        .select(F.col("best._id").alias("_id"), F.col("best._row").alias("_row"))
    )
    names = [fresh(docs, x) for x in ("group_id", "group_row", "own_row")]
    stay = best.union(alone.distinct()).toDF(*names[:2])
    own = docs.withColumn(names[2], F.xxhash64("text"))
    kept = own.join(
        stay, F.col("doc_id").eqNullSafe(F.col(names[0])) & F.col(names[2]).eqNullSafe(F.col(names[1])), "left_semi"
    )
    return kept.dropDuplicates(["doc_id", names[2]]).select(*[F.col(f"`{c}`") for c in docs.columns])


@query("op9_ngram_jaccard", ORACLE)
def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = groups(documents(spark, sf_dir))
    return found.select(
        F.col("_id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id")
    )
