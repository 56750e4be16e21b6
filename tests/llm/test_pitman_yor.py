"""How the language model's rows are packed on their way."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from archipel.llm import pitman_yor
from archipel.llm.pitman_yor import _bucket, _open, _pack, _slices


class _Task:
    @staticmethod
    def get():
        return _Task

    @staticmethod
    def partitionId():
        return 3


def _batch(texts, words, seed=2):
    rng = np.random.default_rng(seed)
    text = [" ".join(f"w{x}" for x in rng.zipf(1.3, words) % 50_000) for _ in range(texts)]
    return pa.RecordBatch.from_arrays([pa.array(range(texts), pa.int64()), pa.array(text), pa.array([int(i % 7 != 2) for i in range(texts)], pa.int32())], ["doc_id", "text", "learn"])


@pytest.mark.parametrize(("kind", "rising"), [(k, r) for k in ("<u4", "<u8", "<i8") for r in (False, True)] + [("<f8", False)])
def test_packed_values_come_back(kind, rising):
    for values in ([], [7], [0, 0, 5, 2**31, 2**32 - 1], [9, 3, 2**32 - 1, 0]):  # also where they fall
        got = _open(_pack(np.array(values), kind, rising), kind, rising)
        assert got.dtype == np.dtype(kind) and got.tolist() == values


def test_places_and_cells_of_a_bucket_take_few_bytes(monkeypatch):
    monkeypatch.setattr(pitman_yor, "TaskContext", _Task)
    rows = [r for seed in range(3) for out in _slices(1, 1)(iter([_batch(300, 200, seed)])) for r in out.to_pylist()]
    group = pa.table({c: [r[c] for r in rows] for c in ("bucket", "slice", *pitman_yor._PACK)})
    (row,) = _bucket(1, 1)((pa.scalar(0),), group).to_pylist()
    cells = len(_open(row["c_count"], "<u4"))
    assert cells > 50_000
    assert len(row["c_pair"]) + len(row["c_ctx2"]) + len(row["c_ctx1"]) < cells / 2
    numbers = sum(len(_open(blob, "<u4")) for blob in row["cell"])
    assert sum(len(blob) for blob in row["cell"]) < 1.5 * numbers


def test_a_slice_is_cut_in_little_memory(monkeypatch):
    monkeypatch.setattr(pitman_yor, "TaskContext", _Task)
    batch = _batch(300, 2000)
    tracemalloc.start()
    for _ in _slices(8, 1)(iter([batch])):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 70 * 300 * 2000  # bytes a token
