"""Exact dedup by content-defined chunk recipes.

Every text is brought to normal form (each run of white space becomes one space) and cut where its
own content says so: after a byte at which a rolling hash of the last ``WINDOW`` bytes has
``CUT_BITS`` zero bits, at the latest after ``LONGEST`` bytes. Equal texts are cut alike. A task
sends each chunk's bytes once; all further places have its hash only, after a comparison with the
bytes sent. Distinct chunks, told apart by their bytes, form the chunk store. A chunk's identifier
is its hash, with a number where several contents share that hash (chunks of such a hash are read
once more and matched by their bytes; the step is left out where there are none), so equal identifiers mean equal bytes. A recipe is the list
of a text's identifiers in order; two texts are equal just if their recipes are. Only recipes, about
a thousandth of the text, are grouped; a long text never moves as a whole, and a chunk that many
texts share moves once for each task.

Null counts as empty, and an empty text has an empty recipe. Of equal texts the row with the least
id stays, null ids last; of rows equal in both, one stays. An empty table gives no rows. Extra
columns are not read, whatever their names. A text lies in one task with about 30 bytes of memory
a byte. Every result depends on the texts and ids alone.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelwright.llm import words as W
from panelwright.llm.common import documents, query, settle

WINDOW = 32
#: Zero bits at a cut: chunks of 4 KiB on average.
CUT_BITS = 12
LONGEST = 1 << 16
HASH_BITS = 64
#: Bytes of chunks a task remembers; beyond them it begins anew, and sends a chunk again.
REMEMBERED = 64 << 20

_GEAR = W.mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).astype(np.uint32)
_SLAB = 1 << 20
_CUT = "_id long, _row long, _bytes long, _sha256 string, _hashes array<long>, _new array<struct<hash:long,content:binary>>"


def normal_form(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with every run of white space as one space, and where each starts."""
    space = W._SPACE[data]
    drop = np.zeros(len(data), bool)
    drop[1:] = space[1:] & space[:-1]
    inner = offsets[:-1]
    drop[inner[inner < len(data)]] = False  # a text's first byte follows none
    out = np.where(space, np.uint8(0x20), data)[~drop]
    gone = np.zeros(len(data) + 1, np.int64)
    np.cumsum(drop, out=gone[1:])
    return out, offsets - gone[offsets]


def cut_points(data: np.ndarray) -> np.ndarray:
    """Ends of all ranges of ``WINDOW`` bytes whose rolling hash asks for a cut."""
    found = []
    mask = np.uint32(((1 << CUT_BITS) - 1) << (32 - CUT_BITS))
    for at in range(0, len(data), _SLAB):
        low = max(at - WINDOW + 1, 0)
        rolled = _GEAR[data[low : at + _SLAB]]
        step = 1
        while step < WINDOW:
            # after this, each value covers twice as many bytes
            rolled[step:] = rolled[step:] + (rolled[:-step] << np.uint32(step))
            step *= 2
        ends = np.flatnonzero((rolled & mask) == 0) + low + 1
        found.append(ends[ends > at])
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def chunk_ends(start: int, end: int, cuts: np.ndarray) -> list[int]:
    """Where the chunks of a text end. Windows that reach over its start do not count."""
    own = cuts[np.searchsorted(cuts, start + WINDOW) : np.searchsorted(cuts, end)].tolist()
    out, last = [], start
    for cut in [*own, end]:
        while cut - last > LONGEST:
            last += LONGEST
            out.append(last)
        if cut > last:
            out.append(cut)
            last = cut
    return out


def _hash(content: bytes, bits: int) -> int:
    h = xxhash.xxh3_64_intdigest(content) >> (64 - bits)
    return h - (1 << 64) if h >= 1 << 63 else h


def _pieces(texts: pa.Array):
    """(first text, normal bytes, offsets, cuts) of consecutive pieces of about a megabyte."""
    data, offsets = W.text_bytes(texts)
    at, n = 0, len(offsets) - 1
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + W.CHUNK_BYTES, "right")) - 1
        end = min(max(end, at + 1), n)
        own, where = normal_form(data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at])
        yield at, own, where, cut_points(own)
        at = end


def _cut(bits: int):
    def run(batches):
        import pyspark

        row = pyspark.TaskContext.get().partitionId() << 40
        sent: dict[int, bytes | None] = {}
        held = 0
        kinds = [
            ("_id", pa.int64()), ("_row", pa.int64()), ("_bytes", pa.int64()), ("_sha256", pa.string()),
            ("_hashes", pa.list_(pa.int64())), ("_new", pa.list_(pa.struct([("hash", pa.int64()), ("content", pa.binary())]))),
        ]
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for first, data, offsets, cuts in _pieces(batch.column(1)):
                whole = memoryview(data)
                rows = []
                for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                    hashes, new, start = [], [], a
                    for end in chunk_ends(a, b, cuts):
                        content = bytes(whole[start:end])
                        h = _hash(content, bits)
                        start = end
                        hashes.append(h)
                        known = sent.get(h, b"")
                        if known == content:
                            continue
                        new.append({"hash": h, "content": content})
                        if held > REMEMBERED:
                            sent.clear()
                            held = 0
                        # of several contents of one hash none is remembered: each place sends its own
                        sent[h] = content if h not in sent else None
                        held += len(content)
                    rows.append((ids[first + i], row, b - a, hashlib.sha256(whole[a:b]).hexdigest(), hashes, new))
                    row += 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, k) for x, (_, k) in zip(zip(*rows), kinds)], names=[n for n, _ in kinds]
                )

    return run


def _contents(bits: int):
    """Every place of the chunks of documents: row, place, hash and bytes."""

    def run(batches):
        for batch in batches:
            rows = batch.column(0).to_pylist()
            for first, data, offsets, cuts in _pieces(batch.column(1)):
                out = []
                for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                    start = a
                    for at, end in enumerate(chunk_ends(a, b, cuts)):
                        content = data[start:end].tobytes()
                        out.append((rows[first + i], at, _hash(content, bits), content))
                        start = end
                if out:
                    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x, k) for x, k in zip(zip(*out), kinds)], names=["_row", "at", "hash", "content"]
                    )

    return run


@dataclass
class Recipes:
    """``chunks``: hash, number, content of each distinct chunk. ``recipes``: _id, _row, _bytes,
    _sha256 and ``recipe``, the (hash, number) of each of a row's chunks in order."""

    chunks: DataFrame
    recipes: DataFrame


def recipes(docs: DataFrame, bits: int = HASH_BITS) -> Recipes:
    """Chunks and recipes of the ``doc_id`` and ``text`` of ``docs``; fewer hash ``bits`` give the same groups."""
    source = docs.select(F.col("doc_id").cast("long").alias("_id"), "text")
    cut = settle(source.mapInArrow(_cut(bits), _CUT))
    contents = cut.select(F.explode("_new").alias("_c")).select("_c.hash", "_c.content").distinct()
    shared = settle(contents.groupBy("hash").agg(F.count("*").alias("_n")).filter("_n > 1").select("hash"))
    plain = F.transform("_hashes", lambda h: F.struct(h.alias("hash"), F.lit(0).alias("number")))
    kept = ["_id", "_row", "_bytes", "_sha256"]
    if shared.isEmpty():
        return Recipes(contents.select("hash", F.lit(0).alias("number"), "content"), cut.select(*kept, plain.alias("recipe")))
    in_order = Window.partitionBy("hash").orderBy("content")
    numbers = settle(
        contents.join(shared, "hash").withColumn("number", F.row_number().over(in_order)).select("hash", "content", "number")
    )
    chunks = contents.join(numbers, ["hash", "content"], "left").select(
        "hash", F.coalesce("number", F.lit(0)).alias("number"), "content"
    )
    places = cut.select("_row", "_id", "_sha256", F.explode("_hashes").alias("hash")).join(shared, "hash")
    unclear = settle(places.select("_row", F.col("_id").alias("_own"), "_sha256").distinct())
    texts = source.join(unclear, F.col("_id").eqNullSafe(F.col("_own"))).filter(F.sha2(_normal(F.col("text")), 256) == F.col("_sha256"))
    again = texts.dropDuplicates(["_row"]).select("_row", "text")
    found = again.mapInArrow(_contents(bits), "_row long, at int, hash long, content binary").join(numbers, ["hash", "content"])
    found = found.groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("at", "number"))).alias("_numbers"))
    step = F.transform(
        "_hashes", lambda h, i: F.struct(h.alias("hash"), F.coalesce(F.element_at("_numbers", i), F.lit(0)).alias("number"))
    )
    return Recipes(chunks, cut.join(found, "_row", "left").select(*kept, step.alias("recipe")))


def _normal(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def groups(recipes_: DataFrame) -> DataFrame:
    """Each row with the id that stays of its group, the group's size, and whether it is that row.

    Groups of one row are left out before rows meet their group, so that a join with all rows is
    against the repeated recipes alone.
    """
    r = settle(recipes_.select("_id", "_row", "_sha256", "recipe"))
    none_last = F.coalesce("_id", F.lit((1 << 63) - 1))
    many = r.groupBy("recipe").agg(
        F.min("_id").alias("_least"), F.min_by("_row", none_last).alias("_first"), F.count("*").alias("_size")
    )
    many = settle(many.filter("_size > 1").withColumnRenamed("recipe", "_recipe"))
    both = r.join(many, F.col("recipe") == F.col("_recipe"), "left")
    return both.select(
        F.col("_id").alias("doc_id"),
        F.when(F.col("_first").isNull(), F.col("_id")).otherwise(F.col("_least")).alias("keep_id"),
        F.coalesce("_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("_first") == F.col("_row"), F.lit(True)).alias("kept"),
        F.col("_sha256").alias("text_sha256"),
    )


def restore(r: Recipes) -> DataFrame:
    """``_row`` and normal ``text`` of every recipe, put together again from the chunks."""
    steps = r.recipes.select("_row", F.posexplode_outer("recipe").alias("at", "step"))
    steps = steps.select("_row", "at", "step.hash", "step.number")
    parts = steps.join(r.chunks, ["hash", "number"], "left")
    ordered = F.array_sort(F.collect_list(F.when(F.col("at").isNotNull(), F.struct("at", "content"))))
    joined = F.aggregate(ordered, F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["content"]))
    return parts.groupBy("_row").agg(joined.cast("string").alias("text"))


ORACLE = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS x FROM documents),
g AS (SELECT *, row_number() OVER (PARTITION BY x ORDER BY doc_id NULLS LAST) AS nth, count(*) OVER (PARTITION BY x) AS size,
  first_value(doc_id) OVER (PARTITION BY x ORDER BY doc_id NULLS LAST) AS keep_id FROM t)
SELECT doc_id, keep_id, size::BIGINT AS group_size, nth = 1 AS kept, sha256(x) AS text_sha256 FROM g
"""


@query("op12_chunk_recipes", ORACLE)
def op12_chunk_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(recipes(documents(spark, sf_dir)).recipes)
