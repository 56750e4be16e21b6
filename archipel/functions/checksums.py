"""Checksums and digests that Spark lacks; CRC-32, SHA-1 and SHA-256 are built in."""

from __future__ import annotations

import hashlib
import hmac
import struct

import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

from archipel.functions.kernels import arrow_kernel


def _reflected_table(polynomial: int) -> list[int]:
    table = []
    for byte in range(256):
        for _ in range(8):
            byte = byte >> 1 ^ (polynomial if byte & 1 else 0)
        table.append(byte)
    return table


_CRC64 = _reflected_table(0xC96C5795D7870F42)
_CRC32_STEP = 0xEDB88320


def crc64_bytes(data: bytes) -> bytes:
    """CRC-64/XZ, eight bytes, greatest first."""
    crc = (1 << 64) - 1
    for byte in data:
        crc = _CRC64[(crc ^ byte) & 0xFF] ^ crc >> 8
    return struct.pack(">Q", crc ^ (1 << 64) - 1)


def xxh64_bytes(data: bytes) -> bytes:
    """XXH64 with seed 0 (Spark's xxhash64 has seed 42), greatest byte first."""
    return xxhash.xxh64_digest(data, seed=0)


_MIRROR = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def bzip2_crc_of(data: bytes) -> int:
    """bzip2's CRC-32 takes bits from the top: the ordinary one of mirrored bytes, mirrored."""
    import zlib

    return int(f"{zlib.crc32(data.translate(_MIRROR)):032b}"[::-1], 2)


def hmac_sha1_of(key: bytes, data: bytes) -> bytes:
    return hmac.new(key, data, hashlib.sha1).digest()


def _matrix_times(matrix: list[int], vector: int) -> int:
    out = 0
    for row in matrix:
        if not vector:
            break
        if vector & 1:
            out ^= row
        vector >>= 1
    return out


def _zero_bytes() -> list[list[int]]:
    """operators[k]: what 2**k zero bytes do to a CRC-32, as a matrix of 32 columns over GF(2); each is the one before, twice."""
    step = [_CRC32_STEP, *(1 << i for i in range(31))]
    out = []
    for k in range(3 + 44):
        if k >= 3:
            out.append(step)
        step = [_matrix_times(step, column) for column in step]
    return out


_ZERO_BYTES = _zero_bytes()


def joined_crc32(crcs: list[int], lengths: list[int]) -> int:
    """The CRC-32 of parts end to end, from the CRC-32 and byte length of each: what came before moves over the zeros that the part's bytes stand for."""
    total = 0
    for crc, length in zip(crcs, lengths, strict=True):
        for k in range(length.bit_length() if total else 0):
            if length >> k & 1:
                total = _matrix_times(_ZERO_BYTES[k], total)
        total ^= crc
    return total


def crc32_joined(left: int, right: int, right_length: int) -> int:
    """The CRC-32 of two parts end to end."""
    return joined_crc32([left, right], [0, right_length])


def _fold(parts: list[dict]) -> int:
    ordered = sorted(parts, key=lambda p: p["i"])
    return joined_crc32([p["crc"] for p in ordered], [p["length"] for p in ordered])


crc64 = arrow_kernel(crc64_bytes, "binary")
xxh64 = arrow_kernel(xxh64_bytes, "binary")
bzip2_crc = arrow_kernel(bzip2_crc_of, "long")
hmac_sha1 = arrow_kernel(hmac_sha1_of, "binary")
crc32_fold = arrow_kernel(_fold, "long")


def pbkdf2_sha1(password: bytes, rounds: int, length: int):
    """A UDF from salts to keys. The password stays in the closure, out of the plan."""

    def derive(salt):
        return hashlib.pbkdf2_hmac("sha1", password, salt, rounds, length)

    return arrow_kernel(derive, "binary")


def bzip2_stream_crc(blocks: Column) -> Column:
    """The CRC of a bzip2 stream from those of its blocks: rotate left by one, xor."""
    return F.aggregate(blocks, F.lit(0).cast("long"), lambda at, crc: (F.shiftleft(at, 1).bitwiseAND(0xFFFFFFFF)).bitwiseOR(F.shiftright(at, 31)).bitwiseXOR(crc))


def tar_checksum(header: Column) -> Column:
    """The unsigned sum of a 512-byte header with its checksum field as spaces."""
    values = F.transform(F.sequence(F.lit(1), F.lit(512)), lambda i: F.when(i.between(149, 156), F.lit(32)).otherwise(F.conv(F.hex(F.substring(header, i, F.lit(1))), 16, 10).cast("int")))
    return F.aggregate(values, F.lit(0), lambda a, b: a + b)
