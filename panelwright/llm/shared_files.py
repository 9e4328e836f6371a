"""Files that tasks write to and read from the folder all executors share.

A task writes under a name of its own and reports it in its rows; only files whose rows Spark has
kept are ever read, so attempts that were lost or ran twice do no harm.
"""

from __future__ import annotations

import os
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs


def _place(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in path and not path.startswith("file:"):
        return pafs.LocalFileSystem(), path
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(path)


def create(folder: str, name: str):
    """A new file for writing, and its path."""
    fs, base = _place(folder)
    fs.create_dir(base, recursive=True)
    own = f"{name}-{uuid.uuid4().hex}"
    return fs.open_output_stream(f"{base}/{own}"), f"{folder}/{own}"


def local_path(path: str) -> str | None:
    """The path of a file on a mounted file system, else None."""
    fs, own = _place(path)
    return own if isinstance(fs, pafs.LocalFileSystem) else None


def open_input(path: str):
    """The file for reading, memory-mapped where the shared folder is mounted."""
    fs, own = _place(path)
    return pa.memory_map(own) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(own)


def array(path: str, kind, length: int) -> np.ndarray:
    """A file of plain numbers, memory-mapped where the shared folder is mounted.

    The file is closed again: a mapping outlives it, so a worker may map more files than it may
    hold open. Where the folder is not mounted the file is read into memory.
    """
    if not length:
        return np.zeros(0, kind)
    with open_input(path) as f:
        return np.frombuffer(f.read_buffer(), kind, length)


class Numbers:
    """Ranges of a file of plain numbers: from a mapping where the shared folder is mounted, else by a
    read for each."""

    def __init__(self, path: str, kind):
        self.kind = np.dtype(kind)
        self.whole = None if local_path(path) is None else array(path, kind, -1)
        self.file = open_input(path) if self.whole is None else None

    def range(self, first: int, length: int) -> np.ndarray:
        if self.whole is not None:
            return self.whole[first : first + length]
        wide = self.kind.itemsize
        return np.frombuffer(self.file.read_at(length * wide, first * wide), self.kind)


def join(*parts: str) -> str:
    return os.path.join(*parts)
