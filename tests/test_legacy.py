"""Old decoders against small encoders written for the test."""

import zlib

from archipel.functions import legacy


class Writer:
    def __init__(self):
        self.value = self.n = 0

    def put(self, value, width):
        self.value |= value << self.n
        self.n += width

    def bytes(self):
        return self.value.to_bytes(-(-self.n // 8), "little")


def test_inflate64_reads_what_both_methods_share():
    data = b"".join(b"line %d of the text, " % (i % 37) for i in range(400)) + bytes(range(256))
    for level in (0, 1, 6):
        packer = zlib.compressobj(level, zlib.DEFLATED, -15, 8, zlib.Z_FIXED if level == 1 else zlib.Z_DEFAULT_STRATEGY)
        packed = b""
        for i in range(0, len(data), 100):  # flushes keep matches short of the code whose meaning differs
            packed += packer.compress(data[i : i + 100]) + packer.flush(zlib.Z_SYNC_FLUSH)
        assert legacy.inflate64(packed + packer.flush()) == data
    w = Writer()
    w.put(1, 1), w.put(1, 2)
    w.put(int(f"{0x30 + ord('a'):08b}"[::-1], 2), 8)
    w.put(int(f"{0b11000101:08b}"[::-1], 2), 8)  # length code 285: 3 and 16 more bits
    w.put(997, 16), w.put(0, 5), w.put(0, 7)
    assert legacy.inflate64(w.bytes()) == b"a" * 1001


def test_unshrink():
    data = b"abababababab" + bytes(range(90)) + b"abcabcabc" * 20
    w, table, width, now = Writer(), {bytes([i]): i for i in range(256)}, 9, b""
    for byte in data:
        longer = now + bytes([byte])
        if longer in table:
            now = longer
            continue
        w.put(table[now], width)
        table[longer] = len(table) + 1
        if table[longer] > 511 and width == 9:
            w.put(256, 9), w.put(1, 9)
            width = 10
        now = bytes([byte])
    w.put(table[now], width)
    assert legacy.unshrink(w.bytes(), len(data)) == data


def test_reduced():
    w = Writer()
    for byte in range(255, -1, -1):
        w.put(2 if byte == ord("a") else 0, 6)
        if byte == ord("a"):
            w.put(ord("b"), 8), w.put(144, 8)
    w.put(ord("a"), 8)
    w.put(0, 1), w.put(0, 1)  # b, the first follower of a
    w.put(ord("a"), 8)
    w.put(0, 1), w.put(1, 1)  # 144
    w.put(4, 8), w.put(1, 8)  # seven bytes from two back
    assert legacy.expand_reduced(w.bytes(), 10, 1) == b"aba" + b"bababab"


def test_explode():
    w = Writer()
    for _ in range(2):  # 64 codes of six bits, four runs of sixteen
        w.put(3, 8)
        for _ in range(4):
            w.put(5, 4), w.put(15, 4)
    code = lambda symbol: int(f"{63 - symbol:06b}"[::-1], 2)
    for letter in b"xyz":
        w.put(1, 1), w.put(letter, 8)
    w.put(0, 1), w.put(2, 6), w.put(code(0), 6), w.put(code(4), 6)  # three back, four and two long
    assert legacy.explode(w.bytes(), 9, False, False) == b"xyzxyzxyz"
