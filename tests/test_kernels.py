"""Kernels and codecs: how much they hold at one time."""

import pyarrow as pa

from archipel.functions import codecs, kernels


def test_dictionaries_fit_the_data():
    """Tables of the largest dictionary for each small text took most of the time."""
    for size, expected in ((0, 1 << 16), (1000, 1 << 16), (70_000, 1 << 17), (9 << 20, 1 << 23)):
        data = bytes(size)
        assert int.from_bytes(codecs.CODECS["lzma_alone"][0](data)[1:5], "little") == expected
        for name, (encoder, decoder) in codecs.CODECS.items():
            assert encoder is None or decoder(encoder(data)) == data, name
    assert codecs.CODECS["lzip"][0](b"x")[5] == 16


def test_kernels_hold_a_slice_at_a_time():
    held = []
    column = pa.array([b"x" * 100_000] * 50 + [None] + [b"y"] * 1000)
    assert [n for _, n in kernels._slices(column)][0] <= kernels.BYTES // 4_000
    assert kernels.applied(lambda a: held.append(a) or a[:1], pa.binary(), column).to_pylist() == [b"x"] * 50 + [None] + [b"y"] * 1000
    assert kernels.applied(lambda a, b: a + b, pa.int64(), pa.array([1, None, 3]), pa.array([4, 5, None])).to_pylist() == [5, None, None]
    assert kernels.applied(bytes, pa.binary(), pa.array([], pa.binary())).to_pylist() == []
