"""Token-id output: Arrow files of equal-length sequences and masks.

Documents are range-partitioned by id, so files follow each other in id order. A task encodes its
documents, appends the end id to each, and packs the ids into sequences of ``LENGTH``: a fixed-size
list of ids and one of mask bits (1: token, 0: filling) per row, in record batches of an Arrow
file. Ids take 16 bits where the vocabulary allows, else 32. Every file begins a sequence of its own, so files are written
independently; the last row of a file is filled up with mask 0. A reader maps a file into memory
and takes any sequence without copying. An index file beside it says where each document lies.
Only files named in the table of files, which Spark commits as a whole, count.

Words are separated by white space here as in the tokenizer, whose ids for a word depend on the
word alone; so each worker encodes every distinct word once and keeps its ids, up to a bound,
after which it starts anew.

Null and empty texts have the end id alone. Null ids come first. Rows with equal ids stand in the
order of their texts' hashes. An empty table gives no files and no rows.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelwright.llm import shared_files, words as W
from panelwright.llm.common import documents, own_folder, query, settle

LENGTH = 2048
END_ID = 2
#: Sequences of a record batch.
ROWS = 256
#: Distinct words a worker keeps the ids of.
CACHE_WORDS = 2_000_000


class WordIds:
    """Token ids of words, by the hash of the word, encoded once each."""

    def __init__(self, tokenizer_path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.slots = np.zeros(0, np.int64)
        self.starts = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 where it is new."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.slots[at], -1)

    def _add(self, keys: np.ndarray, words: list[str]) -> None:
        lists = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        lengths = np.array([len(x) for x in lists], np.int64)
        fresh = np.fromiter((i for x in lists for i in x), np.uint32, int(lengths.sum()))
        slots = len(self.starts) - 1 + np.arange(len(keys))
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(lengths)])
        self.ids = np.concatenate([self.ids, fresh])
        at = np.searchsorted(self.keys, keys)
        self.keys, self.slots = np.insert(self.keys, at, keys), np.insert(self.slots, at, slots)

    def encode(self, w: W.Words) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in order, and how many of them each text has."""
        keys, first, back = np.unique(w.hashes(), return_index=True, return_inverse=True)
        if len(self.keys) + len(keys) > CACHE_WORDS:
            self.clear()
        slots = self._find(keys)
        new = np.flatnonzero(slots < 0)
        if len(new):
            data = w.data.tobytes()
            spans = zip(w.starts[first[new]].tolist(), w.ends[first[new]].tolist())
            self._add(keys[new], [data[a:b].decode("utf-8") for a, b in spans])
            slots = self._find(keys)
        slot = slots[back]
        start, length = self.starts[slot], np.diff(self.starts)[slot]
        upto = np.cumsum(length)
        ids = self.ids[np.repeat(start - (upto - length), length) + np.arange(upto[-1] if len(upto) else 0)]
        whole = np.concatenate([[0], upto])
        return ids, whole[w.first[1:]] - whole[w.first[:-1]]


@lru_cache(maxsize=2)
def word_ids(tokenizer_path: str) -> WordIds:
    return WordIds(tokenizer_path)


def sequence_schema(length: int, vocabulary: int = 1 << 16) -> pa.Schema:
    ids = pa.uint16() if vocabulary <= 1 << 16 else pa.uint32()
    return pa.schema([("input_ids", pa.list_(ids, length)), ("mask", pa.list_(pa.bool_(), length))])


_INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
_FILES = "first long, last long, path string, index_path string, docs long, tokens long, part int"


def with_ends(ids: np.ndarray, counts: np.ndarray, kind=np.uint32) -> np.ndarray:
    """Ids with the end id after each text."""
    ends = np.cumsum(counts + 1)
    out = np.full(int(ends[-1]) if len(ends) else 0, END_ID, kind)
    own = np.ones(len(out), bool)
    own[ends - 1] = False
    out[own] = ids
    return out


def _write(folder: str, tokenizer_path: str, length: int):
    def run(batches):
        import pyspark

        part = pyspark.TaskContext.get().partitionId()
        coder = word_ids(tokenizer_path)
        schema = sequence_schema(length, max(coder.tokenizer.get_vocab_size(), END_ID + 1))
        kind = schema.field("input_ids").type.value_type.to_pandas_dtype()
        opened = None
        docs = tokens = 0
        held: list[np.ndarray] = []
        size, edge = 0, [None, None]

        def put(sink, whole: bool) -> int:
            ids = np.concatenate(held)
            n, tokens_here = len(ids) // length * length, len(ids)
            if whole and n < len(ids):
                n += length
                ids = np.concatenate([ids, np.zeros(n - len(ids), ids.dtype)])
            mask = np.arange(n) < tokens_here
            for at in range(0, n, ROWS * length):
                own = slice(at, min(at + ROWS * length, n))
                sink.write_batch(
                    pa.record_batch(
                        [
                            pa.FixedSizeListArray.from_arrays(pa.array(ids[own]), length),
                            pa.FixedSizeListArray.from_arrays(pa.array(mask[own]), length),
                        ],
                        schema=schema,
                    )
                )
            held[:] = [ids[n:].copy()]
            return len(ids) - n

        for batch in batches:
            for a, b, w in W.chunks(batch.column(1), False):
                if opened is None:
                    stream, path = shared_files.create(folder, f"ids-{part:06d}")
                    index_stream, index_path = shared_files.create(folder, f"index-{part:06d}")
                    opened = (pa.ipc.new_file(stream, schema), pa.ipc.new_file(index_stream, _INDEX))
                ids, counts = coder.encode(w)
                doc_ids = batch.column(0).slice(a, b - a).cast(pa.int64())
                ends = tokens + np.cumsum(counts + 1)
                opened[1].write_batch(
                    pa.record_batch([doc_ids, pa.array(ends - counts - 1), pa.array(counts + 1)], schema=_INDEX)
                )
                edge = [doc_ids[0].as_py() if not docs else edge[0], doc_ids[-1].as_py()]
                held.append(with_ends(ids, counts, kind))
                docs, tokens, size = docs + b - a, int(ends[-1]), size + len(held[-1])
                if size >= ROWS * length:
                    size = put(opened[0], False)
        if opened is not None:
            put(opened[0], True)
            for sink, file in zip(opened, (stream, index_stream)):
                sink.close()
                file.close()
            row = [[edge[0]], [edge[1]], [path], [index_path], [docs], [tokens], [part]]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, k) for x, k in zip(row, kinds)],
                names=["first", "last", "path", "index_path", "docs", "tokens", "part"],
            )

    return run


def write(docs: DataFrame, tokenizer_path: str, length: int = LENGTH) -> DataFrame:
    """Writes the files; returns a row for each, with ``start``: the ids in all files before it."""
    folder = own_folder(docs.sparkSession, "token-ids")
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("_row"))
    dealt = rows.repartitionByRange("doc_id", "_row").sortWithinPartitions("doc_id", "_row").select("doc_id", "text")
    files = settle(dealt.mapInArrow(_write(folder, tokenizer_path, length), _FILES))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    return files.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def sequences(path: str):
    """The sequences of a file: a table over mapped memory, no copy of any row."""
    return pa.ipc.open_file(shared_files.open_input(path))


def _read(length: int):
    """Each document of the files, from their sequences, a record batch at a time."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                reader = sequences(row["path"])
                index = pa.ipc.open_file(shared_files.open_input(row["index_path"])).read_all()
                starts, sizes = index["start"].to_numpy(), index["n_tokens"].to_numpy()
                crc = np.zeros(len(starts), np.int64)
                at = base = 0
                for i in range(reader.num_record_batches):
                    block = reader.get_batch(i)
                    own = slice(block.column(0).offset * length, (block.column(0).offset + block.num_rows) * length)
                    ids = block.column(0).values.to_numpy(zero_copy_only=True)[own]
                    mask = block.column(1).values.to_numpy(zero_copy_only=False)[own]
                    ids = ids[mask]
                    end = base + len(ids)
                    while at < len(starts) and starts[at] < end:
                        a, b = max(starts[at], base), min(starts[at] + sizes[at], end)
                        crc[at] = zlib.crc32(ids[a - base : b - base].astype("<u4", copy=False), int(crc[at]))
                        if starts[at] + sizes[at] > end:
                            break
                        at += 1
                    base = end
                out = [index["doc_id"].combine_chunks(), pa.array(starts + row["start"]), pa.array(sizes), pa.array(crc)]
                yield pa.RecordBatch.from_arrays(
                    [x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in out],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return run


def read(files: DataFrame, length: int = LENGTH) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens``, ``ids_crc32`` of every document in the files."""
    kind = "doc_id long, start long, n_tokens long, ids_crc32 long"
    # a task a file: a given number is kept, whatever little the names weigh
    spread = files.select("path", "index_path", "start").repartition(max(files.count(), 1))
    return spread.mapInArrow(_read(length), kind)


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op6_token_files")
def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(write(documents(spark, sf_dir), tokenizer_file()))
