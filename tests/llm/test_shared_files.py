from __future__ import annotations

import os

import numpy as np

from panelwright.llm import shared_files


def test_mapped_arrays_hold_no_descriptor(tmp_path):
    for i in range(300):
        np.arange(i, i + 5, dtype=np.int64).tofile(tmp_path / f"part{i}")
    before = len(os.listdir("/proc/self/fd"))
    arrays = [shared_files.array(str(tmp_path / f"part{i}"), np.int64, 5) for i in range(300)]
    assert len(os.listdir("/proc/self/fd")) <= before + 1
    assert [int(x.sum()) for x in arrays] == [5 * i + 10 for i in range(300)]
    assert len(shared_files.array("nowhere", np.int64, 0)) == 0


def test_ranges_come_from_mapped_and_from_other_files(tmp_path, monkeypatch):
    path = str(tmp_path / "numbers")
    np.arange(100, dtype=np.uint64).tofile(path)
    mapped = shared_files.Numbers(path, np.uint64)
    monkeypatch.setattr(shared_files, "local_path", lambda path: None)
    read = shared_files.Numbers(path, np.uint64)
    assert mapped.file is None and read.whole is None
    for first, length in ((0, 100), (7, 5), (99, 1), (30, 0)):
        want = list(range(first, first + length))
        assert mapped.range(first, length).tolist() == want and read.range(first, length).tolist() == want
