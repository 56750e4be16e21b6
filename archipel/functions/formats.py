"""Archive formats: by suffix, by leading bytes, and which wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Suffixes of each format, the usual one first.
SUFFIXES = {
    "zip": [".zip", ".zipx", ".krzip", ".jar", ".war", ".ear", ".apk", ".epub", ".odt", ".ods", ".odp", ".docx", ".xlsx", ".pptx", ".whl", ".crx", ".xpi"],
    "tar": [".tar"],
    "tar.gz": [".tar.gz", ".tar.gzip", ".tgz", ".taz"],
    "tar.bz2": [".tar.bz2", ".tar.bz", ".tbz2", ".tbz", ".tb2"],
    "tar.xz": [".tar.xz", ".txz"],
    "tar.zst": [".tar.zst", ".tar.zstd", ".tzst"],
    "tar.lzma": [".tar.lzma", ".tlz"],
    "tar.Z": [".tar.z", ".tz", ".tarz"],
    "tar.lz": [".tar.lz"],
}
#: Leading bytes as hex, in the order they are tried.
MAGIC = [
    ("504B0304", "zip"),
    ("504B0506", "zip"),
    ("504B0708", "zip"),
    ("504B3030", "zip"),
    ("1F8B", "tar.gz"),
    ("425A68", "tar.bz2"),
    ("FD377A585A00", "tar.xz"),
    ("28B52FFD", "tar.zst"),
    ("4C5A4950", "tar.lz"),
    ("1F9D", "tar.Z"),
]
WRITABLE = [f for f in SUFFIXES if f != "tar.Z"]


def by_suffix(path: Column) -> Column:
    """The format a file name implies, or null; a bare `.gz` implies none."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    out = F.when(F.lit(False), F.lit(""))
    for fmt, suffixes in SUFFIXES.items():
        if fmt != "zip":
            for suffix in sorted(suffixes, key=len, reverse=True):
                out = out.when(name.endswith(suffix) & (F.length(name) > len(suffix)), fmt)
    return out.when(F.concat(F.lit("."), F.substring_index(name, ".", -1)).isin(SUFFIXES["zip"]) & F.contains(name, F.lit(".")), "zip")


def by_magic(content: Column) -> Column:
    """The format that the first 512 bytes identify, or null."""
    head = F.hex(F.substring(content, 1, 512))
    out = F.when(F.lit(False), F.lit(""))
    for magic, fmt in MAGIC:
        out = out.when(head.startswith(magic), fmt)
    return out.when(F.substring(head, 2 * 257 + 1, 10) == "7573746172", "tar")


def resolved(explicit: Column, content: Column, path: Column) -> Column:
    """For reading: what was asked for, else the leading bytes, else the suffix."""
    return F.coalesce(explicit, by_magic(content), by_suffix(path))


def resolved_for_write(explicit: Column, path: Column) -> Column:
    return F.coalesce(explicit, by_suffix(path))


def formats(spark: SparkSession) -> DataFrame:
    """All formats with their suffixes and whether they can be written."""
    return spark.createDataFrame([(f, s[0], s, f in WRITABLE) for f, s in SUFFIXES.items()], "format string, extension string, suffixes array<string>, can_write boolean")
