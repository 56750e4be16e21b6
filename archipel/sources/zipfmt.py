"""ZIP bytes to entries and back, in plain Python over bytes."""

from __future__ import annotations

import struct
import time
import zlib
from calendar import timegm

from archipel.functions import crypto, legacy
from archipel.functions.codecs import CODECS, ZIP_METHODS

_CODES = {v: k for k, v in ZIP_METHODS.items()}
_STRENGTH = {1: "aes128", 2: "aes192", 3: "aes256"}
U16, U32 = 0xFFFF, 0xFFFFFFFF


class Malformed(ValueError):
    """Bytes that are not what the format says."""


def dos_seconds(date: int, clock: int) -> int:
    """Unix seconds of DOS fields, each clamped by itself."""
    first = timegm((1980 + (date >> 9), min(max(date >> 5 & 15, 1), 12), 1, 0, 0, 0))
    return first + (max(date & 31, 1) - 1) * 86400 + min(clock >> 11 & 31, 23) * 3600 + min(clock >> 5 & 63, 59) * 60 + min((clock & 31) * 2, 58)


def dos_fields(seconds: int) -> tuple[int, int]:
    t = time.gmtime(max(0, seconds))
    if t.tm_year < 1980:
        return 0x21, 0
    if t.tm_year > 2107:
        return 0xFF9F, 0xBF7D
    return (t.tm_year - 1980) << 9 | t.tm_mon << 5 | t.tm_mday, t.tm_hour << 11 | t.tm_min << 5 | t.tm_sec // 2


def end_record(data: bytes, skipped: int = 0) -> dict:
    """The end of the central directory: the last signature whose comment ends with the file. `data` may lack so many bytes of the file's beginning."""
    at = len(data) - 22
    while at >= max(0, len(data) - 22 - U16):
        at = data.rfind(b"PK\x05\x06", max(0, len(data) - 22 - U16), at + 4)
        if at < 0:
            break
        disk, cd_disk, here, total, size, offset, comment = struct.unpack_from("<4H2IH", data, at + 4)
        if at + 22 + comment == len(data):
            out = {"disk": disk, "cd_disk": cd_disk, "entries": total, "size": size, "offset": offset, "comment": data[at + 22 :], "zip64": False, "at": at}
            if at >= 20 and data[at - 20 : at - 16] == b"PK\x06\x07":
                where = struct.unpack_from("<Q", data, at - 12)[0] - skipped
                if where >= 0 and data[where : where + 4] == b"PK\x06\x06":
                    entries, size, offset = struct.unpack_from("<QQQ", data, where + 32)
                    out |= {"entries": entries, "size": size, "offset": offset, "zip64": True, "at": where}
            if out["offset"] + out["size"] > out["at"] + skipped:
                raise Malformed("the central directory reaches over its end record")
            return out
        at -= 1
    raise Malformed("no end of central directory")


def extra_fields(extra: bytes, usize: int, csize: int, offset: int, disk: int) -> dict:
    """ZIP64 sizes where the fixed fields are full, times, ids and AES facts; unknown fields are passed over."""
    out = {"usize": usize, "csize": csize, "offset": offset, "disk": disk, "mtime": None, "atime": None, "ctime": None, "uid": None, "gid": None, "aes": None}
    at = 0
    while at + 4 <= len(extra):
        kind, size = struct.unpack_from("<HH", extra, at)
        body = extra[at + 4 : at + 4 + size]
        at += 4 + size
        if kind == 0x0001:
            place = 0
            for name, full, form in (("usize", U32, "<Q"), ("csize", U32, "<Q"), ("offset", U32, "<Q"), ("disk", U16, "<I")):
                width = struct.calcsize(form)
                if out[name] == full and place + width <= len(body):
                    out[name] = struct.unpack_from(form, body, place)[0]
                    place += width
        elif kind == 0x5455 and body:
            place = 1
            for bit, name in ((1, "mtime"), (2, "atime"), (4, "ctime")):
                if body[0] & bit and place + 4 <= len(body):
                    out[name] = struct.unpack_from("<I", body, place)[0]  # unsigned, so times after 2038 survive
                    place += 4
        elif kind == 0x000A and len(body) >= 32:
            for name, place in (("mtime", 8), ("atime", 16), ("ctime", 24)):
                if out[name] is None:
                    out[name] = struct.unpack_from("<Q", body, place)[0] // 10_000_000 - 11_644_473_600
        elif kind == 0x5855 and len(body) >= 8:
            atime, mtime = struct.unpack_from("<ii", body)
            out["mtime"] = mtime if out["mtime"] is None else out["mtime"]
            out["atime"] = atime if out["atime"] is None else out["atime"]
            if len(body) >= 12:
                out["uid"], out["gid"] = struct.unpack_from("<HH", body, 8)
        elif kind == 0x7875 and len(body) >= 3:
            n = body[1]
            out["uid"] = int.from_bytes(body[2 : 2 + n], "little")
            out["gid"] = int.from_bytes(body[3 + n : 3 + n + body[2 + n]], "little") if len(body) > 2 + n else None
        elif kind == 0x9901 and len(body) >= 7:
            version, _, strength, method = struct.unpack_from("<H2sBH", body)
            out["aes"] = {"version": version, "strength": strength, "actual_method": method}
    return out


def decoded_name(raw: bytes, flags: int) -> str:
    if flags & 0x800:
        try:
            return raw.decode("utf-8")
        except UnicodeDecodeError:
            pass
    return raw.decode("cp437")


def entries(data: bytes) -> list[dict]:
    """All central directory records; the declared number is not trusted."""
    return records(data, end_record(data)["offset"])


def records(data: bytes, at: int = 0) -> list[dict]:
    """The central records that begin at `at`, up to what is none."""
    out = []
    while data[at : at + 4] == b"PK\x01\x02":
        if at + 46 > len(data):
            raise Malformed("a central record is cut off")
        made, needed, flags, method, clock, date, crc, csize, usize, n, m, k, disk, internal, external, offset = struct.unpack_from("<6H3I5H2I", data, at + 4)
        raw, extra, comment = data[at + 46 : at + 46 + n], data[at + 46 + n : at + 46 + n + m], data[at + 46 + n + m : at + 46 + n + m + k]
        at += 46 + n + m + k
        more = extra_fields(extra, usize, csize, offset, disk)
        name = decoded_name(raw, flags)
        mode = external >> 16 if made >> 8 in (3, 19) else 0
        kind = "symlink" if mode & 0o170000 == 0o120000 else "directory" if name.endswith(("/", "\\")) or mode & 0o170000 == 0o040000 or external & 0x10 else "file"
        dos = dos_seconds(date, clock)
        out.append({
            "ordinal": len(out), "name": name, "size": more["usize"],
            "meta": {"kind": kind, "unix_mode": mode & 0o7777 if mode else None, "dos_attrs": external & 0xFF or None, "mtime": dos if more["mtime"] is None else more["mtime"], "atime": more["atime"], "ctime": more["ctime"], "uid": more["uid"], "gid": more["gid"]},
            "zip": {"raw_name": raw, "comment": decoded_name(comment, flags), "method_code": method, "crc32": crc, "compressed_size": more["csize"], "local_header_offset": more["offset"], "disk_start": more["disk"], "flags": flags, "version_made_by": made, "version_needed": needed, "external_attributes": external, "internal_attributes": internal, "dos_mtime": dos, "aes": more["aes"]},
            "tar": None,
        })
    return out


def record_length(data: bytes, at: int) -> int:
    """Bytes of the central record at a place, 0 where there is none or too little of it to tell."""
    if data[at : at + 4] != b"PK\x01\x02" or at + 46 > len(data):
        return 0
    return 46 + sum(struct.unpack_from("<3H", data, at + 28))


def unpacked(body: bytes, method: int, flags: int, size: int) -> bytes:
    if method in ZIP_METHODS:
        return CODECS[ZIP_METHODS[method]][1](body)
    if method == 1:
        return legacy.unshrink(body, size)
    if 2 <= method <= 5:
        return legacy.expand_reduced(body, size, method - 1)
    if method == 6:
        return legacy.explode(body, size, bool(flags & 2), bool(flags & 4))
    if method == 9:
        return legacy.inflate64(body)
    raise NotImplementedError(f"compression method {method}")


def content(data: bytes, entry: dict, password: bytes | None = None) -> bytes:
    """An entry's bytes, decrypted, decompressed and verified: the size first, then the CRC (AE-2 entries have none)."""
    z = entry["zip"]
    at = z["local_header_offset"]
    if data[at : at + 4] != b"PK\x03\x04":
        raise Malformed("no local header where the directory says")
    n, m = struct.unpack_from("<HH", data, at + 26)
    body = data[at + 30 + n + m : at + 30 + n + m + z["compressed_size"]]
    if len(body) != z["compressed_size"]:
        raise Malformed("an entry's data is cut off")
    method, flags = z["method_code"], z["flags"]
    if flags & 0x40:
        raise Malformed("strong encryption")
    if flags & 1:
        if password is None:
            raise PermissionError("password required")
        if z["aes"]:
            body, method = crypto.aes_open(password, _STRENGTH[z["aes"]["strength"]], body), z["aes"]["actual_method"]
        else:
            clock = struct.unpack_from("<H", data, at + 10)[0]
            body = crypto.zipcrypto_open(password, body, clock >> 8 if flags & 8 else z["crc32"] >> 24)
    out = unpacked(body, method, flags, entry["size"])
    if len(out) != entry["size"]:
        raise Malformed("size mismatch")
    if not (z["aes"] and z["aes"]["version"] == 2) and zlib.crc32(out) != z["crc32"]:
        raise Malformed("checksum mismatch")
    return out


def record(name: str, kind: str, data: bytes, mtime: int, mode: int | None, method: str = "deflate", password: bytes | None = None, scheme: str = "aes256") -> dict:
    """What a local header and a central record need, with the packed payload. Packing that does not help is left out."""
    stored = name.replace("\\", "/")
    if kind == "directory":
        stored, data = stored.rstrip("/") + "/", b""
    code, packed = 0, data
    if kind == "file" and method != "store":
        tried = CODECS[method][0](data)
        if len(tried) < len(data):
            code, packed = _CODES[method], tried
    crc, flags, extra = zlib.crc32(data), 0x800 if not stored.isascii() else 0, struct.pack("<HHBI", 0x5455, 5, 1, min(max(mtime, 0), U32))
    needed = {0: 10, 8: 20, 12: 46, 14: 63, 93: 63, 95: 63}[code]
    if password is not None and kind == "file":
        flags |= 1
        if scheme == "zipcrypto":
            packed, needed = crypto.zipcrypto_seal(password, packed, crc >> 24), max(needed, 20)
        else:
            strength = {v: k for k, v in _STRENGTH.items()}[scheme]
            packed = crypto.aes_seal(password, scheme, packed)
            extra += struct.pack("<HHH2sBH", 0x9901, 7, 2, b"AE", strength, code)
            code, crc, needed = 99, 0, max(needed, 51)
    kinds = {"file": 0o100000, "directory": 0o040000, "symlink": 0o120000}[kind]
    default = {"file": 0o644, "directory": 0o755, "symlink": 0o777}[kind]
    external = (kinds | (mode if mode else default)) << 16 | (0x10 if kind == "directory" else 0)
    return {"name": stored.encode(), "size": len(data), "packed": packed, "crc": crc, "method": code, "flags": flags, "extra": extra, "needed": needed, "external": external, "stamp": dos_fields(mtime)}


def local_header(r: dict) -> bytes:
    date, clock = r["stamp"]
    extra, csize, usize = r["extra"], len(r["packed"]), r["size"]
    if max(csize, usize) >= U32:
        extra = struct.pack("<HHQQ", 1, 16, usize, csize) + extra
        csize = usize = U32
    return struct.pack("<4s5H3I2H", b"PK\x03\x04", max(r["needed"], 45 if csize == U32 else 0), r["flags"], r["method"], clock, date, r["crc"], csize, usize, len(r["name"]), len(extra)) + r["name"] + extra


def central_record(r: dict, offset: int, disk: int = 0) -> bytes:
    date, clock = r["stamp"]
    csize, usize, extra, where = len(r["packed"]), r["size"], r["extra"], offset
    if max(csize, usize, offset) >= U32:
        extra = struct.pack("<HHQQQ", 1, 24, usize, csize, offset) + extra
        csize = usize = where = U32
    needed = max(r["needed"], 45 if where == U32 else 0)
    return struct.pack("<4s6H3I5H2I", b"PK\x01\x02", 3 << 8 | needed, needed, r["flags"], r["method"], clock, date, r["crc"], csize, usize, len(r["name"]), len(extra), 0, disk, 0, r["external"], where) + r["name"] + extra


def rebased(directory: bytes, start: int) -> bytes:
    """Central records of `archive` whose offsets count from `start`, with offsets from the archive's beginning."""
    out, at = [], 0
    while at < len(directory):
        n, m = struct.unpack_from("<HH", directory, at + 28)
        fixed, rest = bytearray(directory[at : at + 46]), directory[at + 46 : at + 46 + n + m]
        needed, csize, usize, offset = *struct.unpack_from("<H", fixed, 6), *struct.unpack_from("<II", fixed, 20), start + struct.unpack_from("<I", fixed, 42)[0]
        if offset >= U32:
            rest = rest[:n] + struct.pack("<HHQQQ", 1, 24, usize, csize, offset) + rest[n:]
            needed = max(needed, 45)
            struct.pack_into("<HH", fixed, 4, 3 << 8 | needed, needed)
            struct.pack_into("<IIHH", fixed, 20, U32, U32, n, m + 28)
        struct.pack_into("<I", fixed, 42, min(offset, U32))
        out += [bytes(fixed), rest]
        at += 46 + n + m
    return b"".join(out)


def ending(n: int, size: int, offset: int, comment: bytes = b"", disk: int = 0, here: int | None = None) -> bytes:
    """The end records, with their ZIP64 forms where a field is full."""
    here, out = n if here is None else here, b""
    if n >= U16 or size >= U32 or offset >= U32:
        out = struct.pack("<4sQ2H2I4Q", b"PK\x06\x06", 44, 3 << 8 | 45, 45, disk, disk, here, n, size, offset) + struct.pack("<4sIQI", b"PK\x06\x07", disk, offset + size, disk + 1)
    comment = comment[:U16]
    return out + struct.pack("<4s4H2IH", b"PK\x05\x06", disk, disk, min(here, U16), min(n, U16), min(size, U32), min(offset, U32), len(comment)) + comment


def archive(records: list[dict], comment: bytes = b"") -> bytes:
    parts, offsets, at = [], [], 0
    for r in records:
        head = local_header(r)
        offsets.append(at)
        parts += [head, r["packed"]]
        at += len(head) + len(r["packed"])
    directory = b"".join(central_record(r, o) for r, o in zip(records, offsets, strict=True))
    return b"".join([*parts, directory, ending(len(records), len(directory), at, comment)])
