"""ZIP encryption: WinZip AES (AE-2) and the traditional stream cipher."""

from __future__ import annotations

import hashlib
import hmac
import os
import zlib

import numpy as np
from pyspark.sql import Column

from archipel.functions.kernels import arrow_kernel

#: Salt and key lengths by strength; rounds, verifier and tag lengths.
STRENGTHS = {"aes128": (8, 16), "aes192": (12, 24), "aes256": (16, 32)}
ROUNDS, VERIFIER, TAG = 1000, 2, 10


def _times(a: int, b: int) -> int:
    """Product in the field of AES."""
    out = 0
    while b:
        if b & 1:
            out ^= a
        a = a << 1 ^ (0x11B if a & 0x80 else 0)
        b >>= 1
    return out


def _boxes() -> np.ndarray:
    """The substitution box, from inverses and the affine map."""
    inverse = [0] * 256
    for x in range(1, 256):
        if not inverse[x]:
            y = next(y for y in range(1, 256) if _times(x, y) == 1)
            inverse[x], inverse[y] = y, x
    box = []
    for v in inverse:
        out = 0x63
        for shift in range(5):
            out ^= (v << shift | v >> (8 - shift)) & 0xFF
        box.append(out)
    return np.array(box, dtype=np.uint8)


_BOX = _boxes()
_SHIFT = np.array([(4 * ((i // 4 + i % 4) % 4)) + i % 4 for i in range(16)])
#: For each byte of a column what it adds to the mixed column, four bytes as one number.
_MIX = [np.roll(np.array([[_times(2, x), x, x, _times(3, x)] for x in _BOX.tolist()], dtype=np.uint8), i, axis=1).copy().view(np.uint32).reshape(-1) for i in range(4)]


def _round_keys(key: bytes) -> np.ndarray:
    box, words = _BOX.tolist(), [key[i : i + 4] for i in range(0, len(key), 4)]
    n, constant = len(words), 1
    for i in range(n, 4 * (n + 7)):
        a, b, c, d = words[-1]
        if i % n == 0:
            a, b, c, d = box[b] ^ constant, box[c], box[d], box[a]
            constant = _times(constant, 2)
        elif n > 6 and i % n == 4:
            a, b, c, d = box[a], box[b], box[c], box[d]
        e, f, g, h = words[-n]
        words.append((a ^ e, b ^ f, c ^ g, d ^ h))
    return np.array([x for w in words for x in w], dtype=np.uint8).reshape(-1, 16)


def aes_blocks(key: bytes, blocks: np.ndarray) -> np.ndarray:
    """All 16-byte blocks (rows) encrypted at once."""
    keys = _round_keys(key)
    state = blocks ^ keys[0]
    for own in keys[1:-1].view(np.uint32):
        turned = np.take(state, _SHIFT, axis=1).reshape(-1, 4, 4)
        mixed = np.take(_MIX[0], turned[:, :, 0])
        for i in (1, 2, 3):
            mixed ^= np.take(_MIX[i], turned[:, :, i])
        mixed ^= own
        state = mixed.view(np.uint8).reshape(-1, 16)
    return np.take(_BOX, np.take(state, _SHIFT, axis=1)) ^ keys[-1]


def ctr(key: bytes, data: bytes) -> bytes:
    """Counter mode with a little-endian counter that begins at 1; decrypting is the same."""
    n = -(-len(data) // 16)
    counters = np.zeros((n, 16), dtype=np.uint8)
    counters[:, :8] = np.arange(1, n + 1, dtype="<u8").view(np.uint8).reshape(n, 8)
    stream = np.zeros(0, np.uint8)
    if n:
        # Blocks of a megabyte at a time: a round takes several times their size.
        stream = np.concatenate([aes_blocks(key, counters[lo : lo + 65536]) for lo in range(0, n, 65536)]).reshape(-1)[: len(data)]
    return (np.frombuffer(data, np.uint8) ^ stream).tobytes()


def _keys(password: bytes, salt: bytes, size: int) -> tuple[bytes, bytes, bytes]:
    both = hashlib.pbkdf2_hmac("sha1", password, salt, ROUNDS, 2 * size + VERIFIER)
    return both[:size], both[size : 2 * size], both[2 * size :]


def aes_seal(password: bytes, scheme: str, data: bytes, salt: bytes | None = None) -> bytes:
    """salt, verifier, ciphertext, tag."""
    salt_length, size = STRENGTHS[scheme]
    salt = os.urandom(salt_length) if salt is None else salt
    key, mac, verifier = _keys(password, salt, size)
    body = ctr(key, data)
    return salt + verifier + body + hmac.new(mac, body, hashlib.sha1).digest()[:TAG]


def aes_open(password: bytes, scheme: str, sealed: bytes) -> bytes:
    salt_length, size = STRENGTHS[scheme]
    key, mac, verifier = _keys(password, sealed[:salt_length], size)
    if sealed[salt_length : salt_length + VERIFIER] != verifier:
        raise ValueError("wrong password")
    body, tag = sealed[salt_length + VERIFIER : -TAG], sealed[-TAG:]
    if not hmac.compare_digest(hmac.new(mac, body, hashlib.sha1).digest()[:TAG], tag):
        raise ValueError("authentication failed")
    return ctr(key, body)


_STEP = [0] * 256
for _byte in range(256):
    _value = _byte
    for _ in range(8):
        _value = _value >> 1 ^ (0xEDB88320 if _value & 1 else 0)
    _STEP[_byte] = _value


class _Stream:
    """The three keys of the traditional cipher."""

    def __init__(self, password: bytes):
        self.k = [0x12345678, 0x23456789, 0x34567890]
        for b in password:
            self.feed(b)

    def feed(self, plain: int) -> None:
        a, b, c = self.k
        a = _STEP[(a ^ plain) & 0xFF] ^ a >> 8
        b = ((b + (a & 0xFF)) * 134775813 + 1) & 0xFFFFFFFF
        self.k = [a, b, _STEP[(c ^ b >> 24) & 0xFF] ^ c >> 8]

    def byte(self) -> int:
        t = (self.k[2] | 2) & 0xFFFF
        return (t * (t ^ 1) >> 8) & 0xFF


def zipcrypto_seal(password: bytes, data: bytes, check: int, noise: bytes | None = None) -> bytes:
    """A header of eleven noise bytes and the check byte, then the data."""
    stream, out = _Stream(password), bytearray()
    for plain in (os.urandom(11) if noise is None else noise) + bytes([check]) + data:
        out.append(plain ^ stream.byte())
        stream.feed(plain)
    return bytes(out)


def zipcrypto_open(password: bytes, sealed: bytes, check: int) -> bytes:
    stream, out = _Stream(password), bytearray()
    for cipher in sealed:
        plain = cipher ^ stream.byte()
        stream.feed(plain)
        out.append(plain)
    if len(out) < 12 or out[11] != check:
        raise ValueError("wrong password")
    return bytes(out[12:])


def encrypt(content: Column, password: bytes, scheme: str = "aes256") -> Column:
    """Sealed content. The password lives in the function's closure, never in the plan's text. Salts are random, so results differ from run to run."""
    if scheme == "zipcrypto":
        return arrow_kernel(lambda data: zipcrypto_seal(password, data, zlib.crc32(data) >> 24), "binary", deterministic=False)(content)
    return arrow_kernel(lambda data: aes_seal(password, scheme, data), "binary", deterministic=False)(content)


def decrypt(content: Column, password: bytes, scheme: str = "aes256", check: Column | None = None) -> Column:
    if scheme == "zipcrypto":
        return arrow_kernel(lambda data, byte: zipcrypto_open(password, data, byte), "binary")(content, check)
    return arrow_kernel(lambda data: aes_open(password, scheme, data), "binary")(content)
