"""Archives as DataFrames: listing, content, packing, volumes, and a data source of the same shape."""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from archipel.functions import formats, paths
from archipel.sources import tarfmt, zipfmt

ENTRY = (
    "archive string, ordinal int, name string, size long, "
    "meta struct<kind:string,unix_mode:int,dos_attrs:smallint,mtime:bigint,atime:bigint,ctime:bigint,uid:bigint,gid:bigint>, "
    "zip struct<raw_name:binary,comment:string,method_code:int,crc32:bigint,compressed_size:bigint,local_header_offset:bigint,disk_start:bigint,flags:int,"
    "version_made_by:int,version_needed:int,external_attributes:bigint,internal_attributes:int,dos_mtime:bigint,aes:struct<version:int,strength:int,actual_method:int>>, "
    "tar struct<typeflag:smallint,linkname:string,uname:string,gname:string,devmajor:bigint,devminor:bigint,sparse:boolean>"
)


def _arrow(ddl: str) -> pa.Schema:
    from pyspark.sql.types import ArrayType, BinaryType, BooleanType, IntegerType, LongType, ShortType, StringType, StructField

    kinds = {"string": StringType(), "int": IntegerType(), "long": LongType(), "bigint": LongType(), "smallint": ShortType(), "boolean": BooleanType(), "binary": BinaryType()}

    def cut(text: str) -> list[str]:
        out, depth = [""], 0
        for c in text:
            depth += (c == "<") - (c == ">")
            if c == "," and not depth:
                out.append("")
            else:
                out[-1] += c
        return [x.strip() for x in out]

    def kind(text: str):
        if text.startswith("struct<"):
            return StructType([StructField(*_pair(x, ":", kind)) for x in cut(text[7:-1])])
        return ArrayType(kind(text[6:-1])) if text.startswith("array<") else kinds[text]

    def _pair(text: str, mark: str, of):
        name, _, rest = text.partition(mark)
        return name.strip(), of(rest.strip())

    return to_arrow_schema(StructType([StructField(*_pair(x, " ", kind)) for x in cut(ddl)]))


def asked(name: str, wanted: list[str] | None) -> bool:
    bare = name.rstrip("/")
    return not wanted or any(bare == w.rstrip("/") or bare.startswith(w.rstrip("/") + "/") for w in wanted)


def parsed(data: bytes, fmt: str, with_content: bool, wanted: list[str] | None, password: bytes | None) -> list[dict]:
    """The entries of one archive; content only of those asked for, so others cannot fail."""
    if fmt == "zip":
        rows = [r for r in zipfmt.entries(data) if asked(r["name"], wanted)]
        if with_content:
            for r in rows:
                r["content"] = zipfmt.content(data, r, password) if r["meta"]["kind"] != "directory" else b""
        return rows
    return [r for r in tarfmt.entries(tarfmt.unwrapped(data, fmt), with_content) if asked(r["name"], wanted)]


def entries_of(files: DataFrame, content: bool = False, fmt: str | None = None, selection: list[str] | None = None, password: bytes | None = None) -> DataFrame:
    """The entries of every archive in `files` (path, content): a row each, with their bytes where `content` is set.

    The format is the one given, else that of the leading bytes, else of the suffix. An
    archive is read in one task; archives are read side by side. The password stays in the
    closure. A damaged or unknown archive fails the job; so does a selected entry that
    cannot be read, while entries that are not selected cannot.
    """
    ddl = ENTRY + (", content binary" if content else "")
    kind = formats.resolved(F.lit(fmt).cast("string"), F.col("content"), F.col("path"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _arrow(ddl)
        for batch in batches:
            for path, data, form in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if form is None:
                    raise zipfmt.Malformed(f"unknown format: {path}")
                rows = [{"archive": path, **r} for r in parsed(data, form, content, selection, password)]
                for lo in range(0, len(rows), 256):
                    yield pa.RecordBatch.from_pylist(rows[lo : lo + 256], schema=schema)

    return files.select("path", "content", kind.alias("format")).mapInArrow(read, ddl)


def read_archives(spark: SparkSession, path: str, **how) -> DataFrame:
    """Entries of the archives at `path` (any store that Spark reads, globs and folders too)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return entries_of(join_volumes(files), **how)


def join_volumes(files: DataFrame) -> DataFrame:
    """Volumes (`.z01` ... `.zip`, or `.001` ...) put together under the archive's own name; whole archives pass."""
    part = files.where(F.col("path").rlike(r"(?i)\.z\d{2,}$|\.\d{3,}$")).select(paths.volume_base(F.col("path")).alias("base")).distinct()
    known = files.withColumn("base", paths.volume_base(F.col("path")))
    split = known.join(part, "base", "left_semi")
    whole = known.join(part, "base", "left_anti").select("path", "content")
    number = F.regexp_extract("path", r"(\d+)$", 1)
    place = F.when(number == "", F.lit(1 << 30)).otherwise(number.cast("int"))
    joined = split.select("base", place.alias("n"), "content").groupBy("base").applyInArrow(_joined, "path string, content binary")
    return whole.unionByName(joined)


def _joined(key: tuple, group: pa.Table) -> pa.Table:
    parts = sorted(zip(group.column("n").to_pylist(), group.column("content").to_pylist(), strict=True))
    data = b"".join(c for _, c in parts)
    return pa.table({"path": [key[0].as_py()], "content": pa.array([data.removeprefix(b"PK\x07\x08") if data[:8] == b"PK\x07\x08PK\x03\x04" and len(parts) == 1 else data], pa.binary())})


def refuse(fmt: str, method: str, password: bytes | None, comment: str, sparse: bool) -> None:
    """Options that a format cannot keep are errors."""
    if fmt not in formats.WRITABLE:
        raise ValueError(f"{fmt} can only be read")
    if fmt != "zip" and (password is not None or comment or method != "deflate"):
        raise ValueError("a tarball keeps no password, comment or method")
    if fmt == "zip" and sparse:
        raise ValueError("a ZIP archive keeps no holes")
    if method not in ("store", "deflate", "bzip2"):
        raise ValueError(f"{method} is not written")


def pack_archives(rows: DataFrame, by: str, fmt: str = "zip", method: str = "deflate", password: bytes | None = None, encryption: str = "aes256", comment: str = "", dialect: str = "pax", sparse: bool = False) -> DataFrame:
    """(path, content, files): one archive for each value of `by`, of rows (name, kind, content, mtime, mode; inode for hard links).

    Entries are sorted by name, so the bytes do not depend on partitioning (but for the
    salts of encryption). Each archive is made in one task and must fit in its memory;
    `sections.pack_sections` makes large ones.
    """
    refuse(fmt, method, password, comment, sparse)

    def pack(key: tuple, group: pa.Table) -> pa.Table:
        own = sorted(group.drop_columns([by]).to_pylist(), key=lambda r: r["name"].encode())
        if fmt == "zip":
            data = zipfmt.archive([zipfmt.record(r["name"], r["kind"], r["content"] or b"", r["mtime"] or 0, r["mode"], method, password, encryption) for r in own], comment.encode())
        else:
            data = tarfmt.wrapped(tarfmt.archive([r | {"mtime": r["mtime"] or 0} for r in own], dialect, sparse), fmt)
        return pa.table({"path": pa.array([f"{key[0].as_py()}{formats.SUFFIXES[fmt][0]}"]), "content": pa.array([data], pa.binary()), "files": pa.array([len(own)], pa.int64())})

    return rows.groupBy(by).applyInArrow(pack, "path string, content binary, files long")


def split_volumes(archives: DataFrame, size: int) -> DataFrame:
    """Raw pieces `.001`, `.002`, ... of at most `size` bytes of every archive."""
    n = F.greatest(F.lit(1), F.ceil(F.octet_length("content") / size)).cast("int")
    cut = archives.select("path", "content", F.explode(F.sequence(F.lit(1), n)).alias("n"))
    return cut.select(paths.piece_name(F.col("path"), F.col("n")).alias("path"), F.substring("content", (F.col("n") - 1) * size + 1, F.lit(size)).alias("content"))


def write_files(files: DataFrame, folder: str) -> None:
    """Writes (path, content) rows under a folder that driver and executors share; a path that links lead out of it is refused."""
    os.makedirs(folder, exist_ok=True)
    root = os.path.realpath(folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                target = os.path.join(folder, path)
                if os.path.commonpath([root, os.path.realpath(os.path.dirname(target))]) != root:
                    raise ValueError(f"{path} leads out of the destination")
                os.makedirs(os.path.dirname(target), exist_ok=True)
                with open(f"{target}.part", "wb") as out:
                    out.write(data)
                os.replace(f"{target}.part", target)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    files.select("path", "content").mapInArrow(write, "n long").agg(F.sum("n")).collect()


class ArchiveSource(DataSource):
    """`spark.read.format("archive")`: option `content` adds the bytes, `type`, `selection` (names split by |) and `password` as in `entries_of`."""

    @classmethod
    def name(cls) -> str:
        return "archive"

    def schema(self) -> str:
        return ENTRY + (", content binary" if self.options.get("content", "false") == "true" else "")

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(dict(self.options), self.schema())


class _Path(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict, ddl: str):
        self.options, self.ddl = options, ddl

    def partitions(self) -> list[InputPartition]:
        where = self.options["path"]
        found = sorted(glob.glob(f"{where}/*") if os.path.isdir(where) else glob.glob(where))
        return [_Path(p) for p in found if os.path.isfile(p)]

    def read(self, partition: _Path) -> Iterator[pa.RecordBatch]:
        with open(partition.path, "rb") as file:
            data = file.read()
        o = self.options
        password = o["password"].encode() if "password" in o else None
        rows = parsed(data, o.get("type") or sniffed(data, partition.path), o.get("content") == "true", [w for w in o.get("selection", "").split("|") if w], password)
        if rows:
            yield pa.RecordBatch.from_pylist([{"archive": partition.path, **r} for r in rows], schema=_arrow(self.ddl))


def sniffed(data: bytes, path: str) -> str:
    """The format by leading bytes, else by suffix."""
    head = data[:512].hex().upper()
    for magic, fmt in formats.MAGIC:
        if head.startswith(magic):
            return fmt
    if data[257:262] == b"ustar":
        return "tar"
    name = os.path.basename(path).lower()
    for fmt, suffixes in formats.SUFFIXES.items():
        if name.endswith(tuple(suffixes)):
            return fmt
    raise zipfmt.Malformed(f"unknown format: {path}")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ArchiveSource)
