"""Decoders for old ZIP methods that no library covers: shrink, reduce, implode, Deflate64. Read only."""

from __future__ import annotations


class Bits:
    """Reads numbers from bytes, least bit first."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> int:
        if self.at + n > 8 * len(self.data):
            raise ValueError("the stream is cut off")
        first, shift = self.at >> 3, self.at & 7
        self.at += n
        return int.from_bytes(self.data[first : (self.at + 7) >> 3], "little") >> shift & ((1 << n) - 1)


def _copy(out: bytearray, distance: int, length: int, zeros: bool = False) -> None:
    """Repeats what lies `distance` back; old methods take what lies before the start for zeros."""
    if distance > len(out) and not zeros:
        raise ValueError("a match begins before the data")
    for _ in range(length):
        out.append(out[-distance] if distance <= len(out) else 0)


def unshrink(data: bytes, size: int) -> bytes:
    """Method 1: LZW of 9 to 13 bits; 256 announces a wider code (1) or that all strings nothing builds on are dropped (2)."""
    bits, width = Bits(data), 9
    prefix: dict[int, int] = {}
    last: dict[int, int] = {i: i for i in range(256)}
    out, before, free = bytearray(), None, 257

    def string(code: int) -> bytes:
        own = bytearray()
        while code > 256:
            own.append(last[code])
            code = prefix[code]
        own.append(code)
        return bytes(reversed(own))

    while len(out) < size:
        code = bits.take(width)
        if code == 256:
            order = bits.take(width)
            if order == 1 and width < 13:
                width += 1
            elif order == 2:
                inner = set(prefix.values())
                for leaf in [c for c in prefix if c not in inner]:
                    del prefix[leaf], last[leaf]
                free = 257
            else:
                raise ValueError("unknown order in a shrunk stream")
            continue
        if before is None:
            own = bytes([code])
        elif code < 256 or code in prefix:
            own = string(code)
        else:
            own = string(before)
            own += own[:1]
        out += own
        if before is not None:
            while free in prefix:
                free += 1
            if free < 8192 and (before < 256 or before in prefix):
                prefix[free], last[free] = before, own[0]
        before = code
    return bytes(out[:size])


def expand_reduced(data: bytes, size: int, factor: int) -> bytes:
    """Methods 2 to 5: bytes guessed from the one before, then runs marked by byte 144."""
    bits = Bits(data)
    followers: list[list[int]] = [[] for _ in range(256)]
    for byte in range(255, -1, -1):
        followers[byte] = [bits.take(8) for _ in range(bits.take(6))]
    out, last, state, head, length = bytearray(), 0, 0, 0, 0
    mask = (1 << (8 - factor)) - 1
    while len(out) < size:
        known = followers[last]
        byte = bits.take(8) if not known or bits.take(1) else known[bits.take(max(1, (len(known) - 1).bit_length()))]
        last = byte
        if state == 0:
            if byte == 144:
                state = 1
            else:
                out.append(byte)
        elif state == 1:
            if not byte:
                out.append(144)
                state = 0
            else:
                head, length = byte, byte & mask
                state = 2 if length == mask else 3
        elif state == 2:
            length += byte
            state = 3
        else:
            _copy(out, (head >> (8 - factor)) * 256 + byte + 1, length + 3, zeros=True)
            state = 0
    return bytes(out[:size])


def _codes(lengths: list[int]) -> dict[tuple[int, int], int]:
    """(length, code) -> symbol of a canonical prefix code whose codes are read from the top bit on."""
    out, code = {}, 0
    for n in range(1, 17):
        code <<= 1
        for symbol, own in enumerate(lengths):
            if own == n:
                out[n, code] = symbol
                code += 1
    return out


def _symbol(bits: Bits, codes: dict[tuple[int, int], int]) -> int:
    code = 0
    for n in range(1, 17):
        code = code << 1 | bits.take(1)
        if (n, code) in codes:
            return codes[n, code]
    raise ValueError("no such code")


def _fano(bits: Bits) -> dict[tuple[int, int], int]:
    """A stored Shannon-Fano tree: runs of code lengths; its codes are those of the canonical code with all bits inverted."""
    lengths: list[int] = []
    for _ in range(bits.take(8) + 1):
        n = bits.take(4) + 1
        lengths += [n] * (bits.take(4) + 1)
    out, code, step, before = {}, 0, 0, 0
    for symbol in sorted(range(len(lengths)), key=lambda s: (lengths[s], s), reverse=True):
        code += step
        if lengths[symbol] != before:
            before = lengths[symbol]
            step = 1 << (16 - before)
        out[before, code >> (16 - before)] = symbol
    return out


def explode(data: bytes, size: int, large_window: bool, literal_tree: bool) -> bytes:
    """Method 6: literals and matches by two or three Shannon-Fano trees."""
    bits, out = Bits(data), bytearray()
    literals = _fano(bits) if literal_tree else None
    lengths, distances = _fano(bits), _fano(bits)
    low, least = 7 if large_window else 6, 3 if literal_tree else 2
    while len(out) < size:
        if bits.take(1):
            out.append(_symbol(bits, literals) if literals else bits.take(8))
        else:
            near = bits.take(low)
            distance = (_symbol(bits, distances) << low | near) + 1
            length = _symbol(bits, lengths)
            if length == 63:
                length += bits.take(8)
            _copy(out, distance, length + least, zeros=True)
    return bytes(out[:size])


def _bases(extras: list[int], first: int) -> list[tuple[int, int]]:
    out = []
    for extra in extras:
        out.append((first, extra))
        first += 1 << extra
    return out


#: Lengths and distances of Deflate64: like deflate's, but the last length has 16 more bits and two more distances exist.
_LENGTHS = [*_bases([0] * 8 + [k for k in range(1, 6) for _ in range(4)], 3)[:28], (3, 16)]
_DISTANCES = _bases([0, 0] + [k for k in range(15) for _ in range(2)], 1)
_ORDER = [16, 17, 18, 0, 8, 7, 9, 6, 10, 5, 11, 4, 12, 3, 13, 2, 14, 1, 15]


def inflate64(data: bytes) -> bytes:
    """Method 9."""
    bits, out, final = Bits(data), bytearray(), 0
    while not final:
        final, kind = bits.take(1), bits.take(2)
        if kind == 0:
            bits.at = -(-bits.at // 8) * 8
            size, check = bits.take(16), bits.take(16)
            if size ^ check != 0xFFFF:
                raise ValueError("a stored block is damaged")
            at = bits.at >> 3
            out += data[at : at + size]
            bits.at += 8 * size
            continue
        if kind == 1:
            literals, distances = _codes([8] * 144 + [9] * 112 + [7] * 24 + [8] * 8), _codes([5] * 32)
        elif kind == 2:
            n, m, k = bits.take(5) + 257, bits.take(5) + 1, bits.take(4) + 4
            meta = [0] * 19
            for i in range(k):
                meta[_ORDER[i]] = bits.take(3)
            names, lengths = _codes(meta), []
            while len(lengths) < n + m:
                s = _symbol(bits, names)
                if s < 16:
                    lengths.append(s)
                elif s == 16:
                    lengths += [lengths[-1]] * (3 + bits.take(2))
                else:
                    lengths += [0] * (3 + bits.take(3) if s == 17 else 11 + bits.take(7))
            literals, distances = _codes(lengths[:n]), _codes(lengths[n : n + m])
        else:
            raise ValueError("unknown block")
        while (s := _symbol(bits, literals)) != 256:
            if s < 256:
                out.append(s)
            else:
                base, extra = _LENGTHS[s - 257]
                length = base + bits.take(extra)
                base, extra = _DISTANCES[_symbol(bits, distances)]
                _copy(out, base + bits.take(extra), length)
    return bytes(out)
