"""Words, lines and their 64-bit hashes, for a whole Arrow batch of texts at once.

A word is a run of bytes outside ``\\x20`` and ``\\x09-\\x0D``. All functions work on the bytes of
the batch as one numpy array, so there is no Python step per text or per word. Hashes depend on
the bytes alone: not on the batch, the partition or the machine.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_LETTER = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + (CHUNK_BYTES >> 2))

        def up(base: int) -> np.ndarray:
            out = np.full(size, base, np.uint64)
            out[0] = 1
            return np.multiply.accumulate(out)

        _powers = (up(_BASE), up(_BASE_INVERSE))
    return _powers[0][:n], _powers[1][:n]


@dataclass
class Words:
    """The words of some texts. ``first`` has the index of each text's first word, and the end."""

    data: np.ndarray
    offsets: np.ndarray
    space: np.ndarray
    sums: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def texts(self) -> int:
        return len(self.offsets) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.texts), self.counts)

    def span_hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of byte ranges; equal bytes give equal hashes wherever they stand."""
        _, down = _powers_to(len(self.data) + 1)
        inner = (self.sums[ends] - self.sums[starts]) * down[starts]
        return mix(inner + (ends - starts).astype(np.uint64))

    def hashes(self) -> np.ndarray:
        return self.span_hashes(self.starts, self.ends)


def split(data: np.ndarray, offsets: np.ndarray, lower: bool) -> Words:
    """Finds the words of the texts that ``offsets`` cut ``data`` into."""
    if lower:
        data = _LOWER[data]
    space = _SPACE[data]
    n = len(data)
    up, _ = _powers_to(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_LETTER[data] * up[:n], out=sums[1:])
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.ones(n, bool)
    before[1:] = space[:-1]
    before |= edge[:n]
    after = np.ones(n, bool)
    after[:-1] = space[1:]
    after |= edge[1:]
    starts = np.flatnonzero(before & ~space)
    ends = np.flatnonzero(after & ~space) + 1
    first = np.searchsorted(starts, offsets)
    return Words(data, offsets, space, sums, starts, ends, first)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array and where each text starts; null texts are empty."""
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if texts.null_count:
        texts = texts.fill_null("")
    _, where, data = texts.buffers()
    offsets = np.frombuffer(where, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    low, high = int(offsets[0]), int(offsets[-1])
    if high == low:
        return np.zeros(0, np.uint8), np.zeros(len(offsets), np.int64)
    return np.frombuffer(data, np.uint8)[low:high], offsets - low


def chunks(texts: pa.Array, lower: bool, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, Words]]:
    """(first text, end text, words) of consecutive pieces of about ``size`` bytes.

    A text is never cut: one longer than ``size`` is a piece of its own.
    """
    data, offsets = text_bytes(texts)
    at, n = 0, len(offsets) - 1
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1
        end = min(max(end, at + 1), n)
        low = offsets[at]
        part = np.array(data[low : offsets[end]])
        yield at, end, split(part, offsets[at : end + 1] - low, lower)
        at = end


def runs(first: np.ndarray, k: int) -> np.ndarray:
    """Indices of the items from which ``k`` items lie in one text."""
    counts = np.diff(first)
    at = np.arange(first[-1])
    return at[at + k <= np.repeat(first[1:], counts)]


def shingle_hashes(hashes: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the ``k`` consecutive items from each index in ``at``."""
    out = np.full(len(at), k, np.uint64)
    for i in range(k):
        out = mix(out * np.uint64(_BASE) + hashes[at + i])
    return out


def order_within(groups: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The order by group, then value. Short group numbers are sorted by radix."""
    by_value = np.argsort(values)
    own = groups[by_value]
    if len(own) and own.max() < 1 << 16:
        own = own.astype(np.uint16)
    return by_value[np.argsort(own, kind="stable")]


def regroup(groups: np.ndarray, values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values of each group, ascending, where each group's values start, and an index at
    which each value stood."""
    order = order_within(groups, values)
    groups, values = groups[order], values[order]
    fresh = np.ones(len(values), bool)
    fresh[1:] = (values[1:] != values[:-1]) | (groups[1:] != groups[:-1])
    groups, values = groups[fresh], values[fresh]
    return values, np.searchsorted(groups, np.arange(n + 1)), order[fresh]
