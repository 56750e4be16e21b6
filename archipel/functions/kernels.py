"""Arrow UDFs over BINARY columns, from plain functions of bytes."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from archipel.llm.common import tidy

_TYPES = {"binary": pa.binary(), "string": pa.string(), "long": pa.int64()}
#: Rows and bytes that are Python objects at one time.
ROWS, BYTES = 256, 2 << 20


def _slices(a: pa.Array):
    """Where slices of a column begin and end: ROWS rows, or fewer where they are large."""
    width = max(1, min(ROWS, BYTES * max(len(a), 1) // max(a.nbytes, 1)))
    return ((lo, width) for lo in range(0, len(a), width))


def applied(kernel: Callable, kind: pa.DataType, *columns: pa.Array) -> pa.Array:
    """`kernel` of each row. Rows become Python objects a slice at a time and results go where they stay, so that a batch is never a list of all its texts and a second one of their results."""
    tidy()
    results = (None if None in row else kernel(*row) for lo, n in _slices(columns[0]) for row in zip(*(c.slice(lo, n).to_pylist() for c in columns), strict=True))
    if kind != pa.binary():
        return pa.array(list(results), kind)
    ends, known, data = np.zeros(len(columns[0]) + 1, np.int32), np.zeros(len(columns[0]), bool), bytearray()
    for i, result in enumerate(results):
        if result is not None:
            known[i] = True
            data += result
        ends[i + 1] = len(data)
    return pa.Array.from_buffers(kind, len(known), [pa.py_buffer(np.packbits(known, bitorder="little")), pa.py_buffer(ends), pa.py_buffer(data)])


def arrow_kernel(kernel: Callable, returns: str, deterministic: bool = True):
    """An Arrow UDF that applies `kernel` to each row; null in any argument gives null. Made when first used, as modules are imported on workers too."""
    kind = _TYPES[returns]

    def one(a: pa.Array) -> pa.Array:
        return applied(kernel, kind, a)

    def two(a: pa.Array, b: pa.Array) -> pa.Array:
        return applied(kernel, kind, a, b)

    def three(a: pa.Array, b: pa.Array, c: pa.Array) -> pa.Array:
        return applied(kernel, kind, a, b, c)

    def of(*columns):
        udf = F.arrow_udf({1: one, 2: two, 3: three}[len(columns)], returns)
        return (udf if deterministic else udf.asNondeterministic())(*columns)

    return of
