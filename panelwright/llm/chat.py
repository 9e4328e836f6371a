"""Chat formatting: token-level assembly of conversations with loss masks.

The parts of a turn, its role and its text, are encoded separately by a byte-level tokenizer and
joined by reserved ids that no text can give: one opens a turn, one ends the role, one closes the
turn. The loss mask is the running sum of +1 where an assistant's text begins and -1 where it ends.
Reserved ids are shown as the template's strings; where such a string occurs in a text, a backslash
is put before it, and taken away again in reading, so a text may hold anything, backslashes too.

Output is one row per turn, in order within its conversation, so no conversation is collected.

A null text or role is empty; a null id is one conversation, a null turn comes first. Turns with
equal numbers stand in the order of role and text; repeated rows are repeated turns. An empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.llm.common import query, settle
from panelwright.llm.token_files import tokenizer_file

#: The template's strings, in the order of their reserved ids.
OPEN, ROLE_END, CLOSE = "### ", ": ", " </turn>\n"
#: Strings that are escaped in texts; in roles ``:`` is too.
CONTROL = re.compile(r"(### |</turn>)")
ROLE_CONTROL = re.compile(r"(### |</turn>|:)")
ESCAPED = re.compile(r"\\(### |</turn>)")
ROLE_ESCAPED = re.compile(r"\\(### |</turn>|:)")
LEARNED = "assistant"


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True  # their strings in a text are ordinary text
    return t


def escape(text: str) -> str:
    return CONTROL.sub(r"\\\1", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def assemble(roles: list[str], texts: list[str], tokenizer, reserved: int):
    """Token ids of each turn, and the loss mask of each."""
    role_ids = [e.ids for e in tokenizer.encode_batch_fast([ROLE_CONTROL.sub(r"\\\1", r) for r in roles], add_special_tokens=False)]
    text_ids = [e.ids for e in tokenizer.encode_batch_fast([escape(t) for t in texts], add_special_tokens=False)]
    flat: list[int] = []
    ends = np.zeros(len(roles) + 1, np.int64)
    steps_at: list[int] = []
    for i, (r, t) in enumerate(zip(role_ids, text_ids)):
        flat.append(reserved)
        flat += r
        flat.append(reserved + 1)
        begin = len(flat)
        flat += t
        if roles[i] == LEARNED:
            steps_at += (begin, len(flat))
        flat.append(reserved + 2)
        ends[i + 1] = len(flat)
    step = np.zeros(len(flat) + 1, np.int64)
    np.add.at(step, steps_at[0::2], 1)
    np.add.at(step, steps_at[1::2], -1)
    return np.array(flat, np.int32), np.cumsum(step)[:-1].astype(np.int8), ends


def _lists(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values))


def _format(path: str, reserved: int):
    def run(batches):
        tokenizer = _tokenizer(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                roles, texts = part.column(2).to_pylist(), part.column(3).to_pylist()
                ids, mask, ends = assemble(roles, texts, tokenizer, reserved)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(4), _lists(ids, ends), _lists(mask.astype(np.int32), ends)],
                    names=["conv_id", "turn", "tie", "input_ids", "loss_mask"],
                )

    return run


_TURNS = "conv_id long, turn long, tie string, input_ids array<int>, loss_mask array<int>"


def format_turns(conversations: DataFrame, tokenizer_path: str) -> DataFrame:
    """``conv_id, turn, tie, input_ids, loss_mask``: one row per turn; ``tie`` orders equal turns."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    tie = F.concat_ws("\n", role, F.sha2(text, 256))
    rows = conversations.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), role.alias("role"), text.alias("text"), tie.alias("tie")
    )
    reserved = _tokenizer(tokenizer_path).get_vocab_size()
    return rows.mapInArrow(_format(tokenizer_path, reserved), _TURNS)


def _read(path: str, reserved: int):
    def run(batches):
        tokenizer = _tokenizer(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                out = []
                pieces, kinds = [], []
                for ids, mask in zip(part.column(3), part.column(4)):
                    x, m = (np.asarray(v.values) for v in (ids, mask))
                    mid = int(np.flatnonzero(x == reserved + 1)[0])
                    pieces += [x[1:mid].tolist(), x[mid + 1 : -1].tolist(), x[m == 1].tolist()]
                texts = tokenizer.decode_batch(pieces, skip_special_tokens=False)
                for i in range(part.num_rows):
                    role, text, learned = texts[3 * i : 3 * i + 3]
                    shown = len(OPEN) + len(role) + len(ROLE_END) + len(text) + len(CLOSE)
                    out.append((ROLE_ESCAPED.sub(r"\1", role), unescape(text), unescape(learned), shown))
                role, text, learned, shown = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(2), pa.array(role, pa.string()), pa.array(text, pa.string()),
                     pa.array(learned, pa.string()), pa.array(shown, pa.int64())],
                    names=["conv_id", "turn", "tie", "role", "text", "learned", "shown"],
                )

    return run


_READ = "conv_id long, turn long, tie string, role string, text string, learned string, shown long"


def read_turns(turns: DataFrame, tokenizer_path: str) -> DataFrame:
    """The turns as their tokens say: role, text, text under the mask, and characters shown."""
    reserved = _tokenizer(tokenizer_path).get_vocab_size()
    return turns.mapInArrow(_read(tokenizer_path, reserved), _READ)


_DIGEST = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
)


def _digest(batches):
    """Digests of conversations whose turns come one after the other; holds one turn at a time."""
    now, state = None, None

    def close():
        n, turns, chars, loss, shown = state
        values = (now[0], n, turns.hexdigest(), chars, loss.hexdigest(), shown)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        names = [x.split()[0] for x in _DIGEST.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=names)

    done = []
    for batch in batches:
        columns = [batch.column(c) for c in ("conv_id", "role", "text", "learned", "shown")]
        for conv, role, text, learned, shown in zip(*columns):
            key = (conv.as_py(),)
            if key != now:
                if now is not None:
                    done.append(close())
                now, state = key, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            state[0] += 1
            state[1].update(f"{role.as_py()}\n{text.as_py()}\n".encode())
            state[2] += len(learned.as_py())
            state[3].update(learned.as_py().encode())
            state[4] += shown.as_py()
        if len(done) > 4096:
            yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
            done = []
    if now is not None:
        done.append(close())
    if done:
        yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]


def digests(read: DataFrame) -> DataFrame:
    """One row per conversation. A digest needs its turns in order, so a conversation passes through
    one task, as a stream."""
    dealt = read.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "tie")
    return dealt.mapInArrow(_digest, _DIGEST)


ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (
  SELECT *, role || chr(10) || text || chr(10) AS whole, CASE WHEN role = 'assistant' THEN text ELSE '' END AS learned,
    length(regexp_replace(role, '(### |</turn>|:)', '\\\1', 'g')) + length(regexp_replace(text, '(### |</turn>)', '\\\1', 'g')) + 15 AS shown
  FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(whole, '' ORDER BY turn NULLS FIRST, role, sha256(text))) AS turns_sha256,
  sum(length(learned))::BIGINT AS loss_chars, sha256(string_agg(learned, '' ORDER BY turn NULLS FIRST, role, sha256(text))) AS loss_sha256,
  sum(shown)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


@query("op3_chat_tokens", ORACLE)
def op3_chat_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_file("byte_bpe_50k.json")
    probe = "\\### Assistant: </turn> ok"
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    return digests(read_turns(settle(format_turns(rows.unionByName(more), path)), path))
