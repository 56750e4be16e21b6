"""Compression kernels and their registry; libraries do the work wherever one covers the format."""

from __future__ import annotations

import bz2
import gzip
import lzma
import struct
import zlib
from collections.abc import Callable

import zstandard
from pyspark.sql import Column
from pyspark.sql import functions as F

from archipel.functions.kernels import arrow_kernel

_LEVEL = {"none": 0, "fast": 1, "default": 6, "best": 9}


def _deflate(data: bytes, level: str = "default") -> bytes:
    packer = zlib.compressobj(_LEVEL[level], zlib.DEFLATED, -15)
    return packer.compress(data) + packer.flush()


def _inflate(data: bytes) -> bytes:
    return zlib.decompress(data, -15)


def deflate_piece(data: bytes, last: bool) -> bytes:
    """A piece of a deflate stream that others may follow: all but the last end on a byte with an empty stored block."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    return packer.compress(data) + packer.flush(zlib.Z_FINISH if last else zlib.Z_FULL_FLUSH)


def _unzstd(data: bytes) -> bytes:
    """All frames of the data, one after another."""
    out = []
    while data:
        reader = zstandard.ZstdDecompressor(max_window_size=1 << 31).decompressobj()
        out.append(reader.decompress(data))
        data = reader.unused_data
    return b"".join(out)


#: The largest dictionary, that of preset 6.
DICTIONARY = 1 << 23


def dictionary(size: int) -> int:
    """The dictionary for data of so many bytes, as the reference chooses it: the next power of two, 64 KiB to 8 MiB. An encoder's tables, set to zero for each text, grow with it."""
    return min(max(1 << max(size - 1, 0).bit_length(), 1 << 16), DICTIONARY)


def sized(kind: int, data: bytes) -> dict:
    return {"id": kind, "preset": 6, "dict_size": dictionary(len(data))}


def _zip_lzma(data: bytes) -> bytes:
    """LZMA as a ZIP entry holds it: two version bytes, the length of the properties, the properties, the stream with an end mark."""
    own = sized(lzma.FILTER_LZMA1, data)
    packer = lzma.LZMACompressor(lzma.FORMAT_RAW, filters=[own])
    props = lzma._encode_filter_properties(own)
    return struct.pack("<BBH", 9, 20, len(props)) + props + packer.compress(data) + packer.flush()


def _zip_unlzma(data: bytes) -> bytes:
    size = struct.unpack_from("<H", data, 2)[0]
    how = lzma._decode_filter_properties(lzma.FILTER_LZMA1, data[4 : 4 + size])
    return lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=[how]).decompress(data[4 + size :])


def _lzip(data: bytes) -> bytes:
    return lzip_member(data, sized(lzma.FILTER_LZMA1, data))


def lzip_member(data: bytes, own: dict) -> bytes:
    """One lzip member: magic, version, dictionary code, raw LZMA (lc 3, lp 0, pb 2), then CRC-32 and both sizes."""
    packer = lzma.LZMACompressor(lzma.FORMAT_RAW, filters=[own | {"lc": 3, "lp": 0, "pb": 2}])
    body = packer.compress(data) + packer.flush()
    return b"LZIP\x01" + bytes([own["dict_size"].bit_length() - 1]) + body + struct.pack("<IQQ", zlib.crc32(data), len(data), len(body) + 26)


def _unlzip(data: bytes) -> bytes:
    out = []
    while data[:4] == b"LZIP":
        code = data[5]
        size = (1 << (code & 31)) - ((1 << (code & 31)) // 16) * (code >> 5)
        reader = lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_LZMA1, "dict_size": size, "lc": 3, "lp": 0, "pb": 2}])
        own = reader.decompress(data[6:])
        rest = reader.unused_data
        crc, length, _ = struct.unpack_from("<IQQ", rest)
        if crc != zlib.crc32(own) or length != len(own):
            raise ValueError("lzip member is damaged")
        out.append(own)
        data = rest[20:]
    return b"".join(out)


def _many_bz2(data: bytes) -> bytes:
    return bz2.decompress(data)


def _uncompress(data: bytes) -> bytes:
    """Unix `.Z`: LZW codes of 9 to 16 bits, read in groups of eight codes of one width."""
    if data[:2] != b"\x1f\x9d":
        raise ValueError("not a .Z stream")
    most, blocks = data[2] & 31, bool(data[2] & 128)
    table = [bytes([i]) for i in range(256)] + ([b""] if blocks else [])
    first = len(table)
    out, at, width, last = [], 24, 9, b""
    start, end = at, 8 * len(data)
    bits = int.from_bytes(data, "little")
    while at + width <= end:
        code = (bits >> at) & ((1 << width) - 1) if len(data) < 4096 else int.from_bytes(data[at >> 3 : (at >> 3) + 4], "little") >> (at & 7) & ((1 << width) - 1)
        at += width
        if blocks and code == 256:
            at = start + -(-(at - start) // (8 * width)) * 8 * width
            table, width, last, start = table[:first], 9, b"", at
            continue
        if code < len(table):
            entry = table[code]
        elif code == len(table) and last:
            entry = last + last[:1]
        else:
            raise ValueError("code beyond the table")
        out.append(entry)
        if last and len(table) < 1 << most:
            table.append(last + entry[:1])
        last = entry
        if len(table) >= 1 << width and width < most:
            at = start + -(-(at - start) // (8 * width)) * 8 * width
            width, start = width + 1, at
    return b"".join(out)


def best_of(data: bytes) -> bytes:
    """One byte for the method and the smaller form: deflate only where it is strictly smaller."""
    packed = _deflate(data)
    return b"\x08" + packed if len(packed) < len(data) else b"\x00" + data


#: name -> (encoder or None, decoder)
CODECS: dict[str, tuple[Callable | None, Callable]] = {
    "store": (bytes, bytes),
    "deflate": (_deflate, _inflate),
    "bzip2": (bz2.compress, _many_bz2),
    "lzma": (_zip_lzma, _zip_unlzma),
    "lzma_alone": (lambda b: lzma.compress(b, lzma.FORMAT_ALONE, filters=[sized(lzma.FILTER_LZMA1, b)]), lambda b: lzma.decompress(b, lzma.FORMAT_ALONE)),
    "lzma2": (lambda b: lzma.compress(b, lzma.FORMAT_RAW, filters=[sized(lzma.FILTER_LZMA2, b)]), lambda b: lzma.decompress(b, lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_LZMA2}])),
    "xz": (lambda b: lzma.compress(b, lzma.FORMAT_XZ, lzma.CHECK_CRC64, filters=[sized(lzma.FILTER_LZMA2, b)]), lzma.decompress),
    "zstd": (lambda b: zstandard.ZstdCompressor(write_checksum=True).compress(b), _unzstd),
    "gzip": (lambda b: gzip.compress(b, mtime=0), gzip.decompress),
    "lzip": (_lzip, _unlzip),
    "compress": (None, _uncompress),
}
#: ZIP method codes.
ZIP_METHODS = {0: "store", 8: "deflate", 12: "bzip2", 14: "lzma", 93: "zstd", 95: "xz"}
XZ_FILTERS = {"delta": [{"id": lzma.FILTER_DELTA, "dist": 4}], "x86": [{"id": lzma.FILTER_X86}], "arm": [{"id": lzma.FILTER_ARM}], "armthumb": [{"id": lzma.FILTER_ARMTHUMB}], "powerpc": [{"id": lzma.FILTER_POWERPC}], "sparc": [{"id": lzma.FILTER_SPARC}]}


def encode(content: Column, codec: str) -> Column:
    encoder = CODECS[codec][0]
    if encoder is None:
        raise ValueError(f"{codec} can only be read")
    return arrow_kernel(lambda data: encoder(data), "binary")(content)


def decode(content: Column, codec: str) -> Column:
    decoder = CODECS[codec][1]
    return arrow_kernel(lambda data: decoder(data), "binary")(content)


def xz_filtered(content: Column, name: str) -> Column:
    """xz with a filter before LZMA2; `decode(..., "xz")` reads it."""
    return arrow_kernel(lambda data: lzma.compress(data, lzma.FORMAT_XZ, filters=[*XZ_FILTERS[name], sized(lzma.FILTER_LZMA2, data)]), "binary")(content)


def chunks(content: Column, size: int = 2 << 20) -> Column:
    """struct(i, data, last) of each piece of at most `size` bytes; an empty content is one empty piece."""
    n = F.greatest(F.lit(1), F.ceil(F.octet_length(content) / size)).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.alias("i"), F.substring(content, i * size + 1, F.lit(size)).alias("data"), (i == n - 1).alias("last")))


deflate_chunk = arrow_kernel(deflate_piece, "binary")
smaller = arrow_kernel(best_of, "binary")
