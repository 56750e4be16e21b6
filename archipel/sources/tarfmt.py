"""Tar bytes to entries and back, over the standard library's reader and writer."""

from __future__ import annotations

import io
import lzma
import tarfile
import zlib
from collections.abc import Iterator

import numpy as np

from archipel.functions.codecs import CODECS, DICTIONARY, dictionary, lzip_member

WRAPPERS = {"tar": "store", "tar.gz": "gzip", "tar.bz2": "bzip2", "tar.xz": "xz", "tar.zst": "zstd", "tar.lzma": "lzma_alone", "tar.lz": "lzip", "tar.Z": "compress"}
_KINDS = {tarfile.DIRTYPE: "directory", tarfile.SYMTYPE: "symlink"}
_FORMATS = {"ustar": tarfile.USTAR_FORMAT, "gnu": tarfile.GNU_FORMAT, "pax": tarfile.PAX_FORMAT}
BLOCK, SPARSE_LEAST = 512, 1 << 20


def unwrapped(data: bytes, fmt: str) -> bytes:
    return CODECS[WRAPPERS[fmt]][1](data)


def lzma_filter(kind: int, size: int) -> dict:
    """How tarballs are searched for matches: as the reference does by default, chains of 32 with one look ahead, as one stream is one task's work."""
    return {"id": kind, "preset": 6, "dict_size": dictionary(size), "mode": lzma.MODE_FAST, "mf": lzma.MF_HC4, "depth": 32}


def wrapped(data: bytes, fmt: str) -> bytes:
    codec = WRAPPERS[fmt]
    if codec == "xz":
        return lzma.compress(data, lzma.FORMAT_XZ, lzma.CHECK_CRC64, filters=[lzma_filter(lzma.FILTER_LZMA2, len(data))])
    if codec == "lzma_alone":
        return lzma.compress(data, lzma.FORMAT_ALONE, filters=[lzma_filter(lzma.FILTER_LZMA1, len(data))])
    if codec == "lzip":
        return lzip_member(data, lzma_filter(lzma.FILTER_LZMA1, len(data)))
    encoder = CODECS[codec][0]
    if encoder is None:
        raise ValueError(f"{fmt} can only be read")
    return encoder(data)


def entries(data: bytes, with_content: bool = False) -> list[dict]:
    """Records of an unwrapped tar. Types that are no known kind count as files, as devices and pipes are `special`."""
    with tarfile.open(fileobj=io.BytesIO(data), mode="r:", ignore_zeros=False, errors="replace") as tar:
        return [_row(tar, t, n, with_content) for n, t in enumerate(tar)]


def streamed(stream: io.RawIOBase, with_content: bool = False) -> Iterator[dict]:
    """The same of a tar that can only be read once, from front to back; no entry is kept."""
    with tarfile.open(fileobj=stream, mode="r|", ignore_zeros=False, errors="replace") as tar:
        for n, t in enumerate(tar):
            yield _row(tar, t, n, with_content)
            tar.members = []


def _row(tar: tarfile.TarFile, t: tarfile.TarInfo, n: int, with_content: bool) -> dict:
    kind = _KINDS.get(t.type, "special" if t.type in (tarfile.CHRTYPE, tarfile.BLKTYPE, tarfile.FIFOTYPE) else "hardlink" if t.type == tarfile.LNKTYPE else "file")
    name = t.name + ("/" if kind == "directory" and not t.name.endswith("/") else "")
    row = {
        "ordinal": n, "name": name, "size": t.size if kind == "file" else 0,
        "meta": {"kind": kind, "unix_mode": t.mode & 0o7777, "dos_attrs": None, "mtime": int(t.mtime), "atime": None, "ctime": None, "uid": t.uid, "gid": t.gid},
        "zip": None,
        "tar": {"typeflag": t.type[0], "linkname": t.linkname, "uname": t.uname, "gname": t.gname, "devmajor": t.devmajor, "devminor": t.devminor, "sparse": t.issparse()},
    }
    if with_content:
        row["content"] = tar.extractfile(t).read() if kind == "file" else t.linkname.encode() if kind == "symlink" else b""
    return row


def holes(data: bytes) -> list[tuple[int, int]]:
    """The segments that hold data: blocks with a byte set, neighbours joined; the last may end within a block."""
    n = -(-len(data) // BLOCK)
    padded = np.frombuffer(data.ljust(n * BLOCK, b"\0"), np.uint8).reshape(n, BLOCK)
    full = np.concatenate([[False], padded.any(axis=1), [False]])
    starts, ends = np.flatnonzero(full[1:] & ~full[:-1]), np.flatnonzero(~full[1:] & full[:-1])
    return [(int(a) * BLOCK, min(int(b) * BLOCK, len(data)) - int(a) * BLOCK) for a, b in zip(starts, ends, strict=True)]


def expand(segments: list[tuple[int, int]], stored: bytes, size: int) -> bytes:
    out, at = bytearray(size), 0
    for offset, length in segments:
        out[offset : offset + length] = stored[at : at + length]
        at += length
    return bytes(out)


def archive(rows: list[dict], dialect: str = "pax", sparse: bool = False, hard_links: bool = True) -> bytes:
    """A tar of rows (name, kind, content, mtime, mode) in order. Later files with the content and inode of an earlier one become links to it."""
    raw, seen = io.BytesIO(), {}
    with opened(raw, dialect) as tar:
        for r in rows:
            linked = hard_links and r["kind"] not in ("directory", "symlink") and r.get("inode") is not None
            add(tar, r, seen.get(r["inode"]) if linked else None, sparse)
            if linked:
                seen.setdefault(r["inode"], r["name"])
    return raw.getvalue()


def opened(raw: io.BytesIO, dialect: str = "pax") -> tarfile.TarFile:
    return tarfile.open(fileobj=raw, mode="w:", format=_FORMATS[dialect])


def add(tar: tarfile.TarFile, r: dict, link_to: str | None = None, sparse: bool = False) -> None:
    """One more entry; with `link_to`, a hard link to that name."""
    t = tarfile.TarInfo(r["name"])
    t.mtime, t.mode = r["mtime"], r["mode"] or {"directory": 0o755, "symlink": 0o777}.get(r["kind"], 0o644)
    data = r["content"] or b""
    if r["kind"] == "directory":
        t.type, data = tarfile.DIRTYPE, b""
    elif r["kind"] == "symlink":
        t.type, t.linkname, data = tarfile.SYMTYPE, data.decode(), b""
    elif link_to is not None:
        t.type, t.linkname, data = tarfile.LNKTYPE, link_to, b""
    elif sparse and len(data) >= SPARSE_LEAST:
        data, t = _sparse(t, data)
    t.size = len(data)
    tar.addfile(t, io.BytesIO(data))


def ending(size: int) -> bytes:
    """What follows entries of so many bytes: two empty blocks, then zeros up to a whole record."""
    return bytes(2 * BLOCK + -(size + 2 * BLOCK) % tarfile.RECORDSIZE)


def _sparse(t: tarfile.TarInfo, data: bytes) -> tuple[bytes, tarfile.TarInfo]:
    segments = holes(data)
    lines = "".join(f"{x}\n" for x in [len(segments), *(v for s in segments for v in s)]).encode()
    stored = b"".join(data[o : o + n] for o, n in segments)
    if len(stored) + len(lines) + BLOCK >= len(data):
        return data, t
    t.pax_headers = {"GNU.sparse.major": "1", "GNU.sparse.minor": "0", "GNU.sparse.name": t.name, "GNU.sparse.realsize": str(len(data))}
    t.name = f"GNUSparseFile.0/{t.name}"
    return lines.ljust(-(-len(lines) // BLOCK) * BLOCK, b"\0") + stored, t


def checksum(header: bytes) -> int:
    return sum(header[:148]) + 8 * 32 + sum(header[156:512])


def crc(data: bytes) -> int:
    return zlib.crc32(data)
