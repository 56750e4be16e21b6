"""Archives to files and files to archives, on storage that driver and executors share."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archipel.operators.layout import extract_summary, place, resolve_collisions
from archipel.sources.archives import pack_archives, read_archives, write_files


def extract(spark: SparkSession, path: str, folder: str, strip: int = 0, strip_root: bool = False, unsafe: str = "refuse", overwrite: str = "always", selection: list[str] | None = None, password: bytes | None = None) -> DataFrame:
    """Extracts files below `folder` and returns the summary row. All names are checked before a byte is written; a hard link's name gets its target's bytes; symbolic links are counted, not made."""
    if os.path.islink(folder):
        raise ValueError("the destination is a link")
    rows = read_archives(spark, path, content=True, selection=selection, password=password).withColumn("kind", F.col("meta.kind"))
    planned = resolve_collisions(place(rows, strip, strip_root, False, unsafe), overwrite).persist()
    summary = extract_summary(planned).collect()
    placed = planned.where("status = 'placed'")
    write_files(placed.where("kind = 'file'").select("path", "content").unionByName(_linked(rows, placed)), folder)
    planned.unpersist()
    return spark.createDataFrame(summary)


def _linked(rows: DataFrame, placed: DataFrame) -> DataFrame:
    """(path, content) of placed hard links: the bytes of the file entry that they name, if it was read."""
    links = placed.where("kind = 'hardlink'").select("archive", F.col("tar.linkname").alias("name"), "path")
    # Of entries of one name the last is the file's content.
    last = rows.where("kind = 'file'").groupBy("archive", "name").agg(F.max_by("content", "ordinal").alias("content"))
    return links.join(last, ["archive", "name"]).select("path", "content")


def create(spark: SparkSession, folder: str, archive: str, fmt: str = "zip", **how) -> DataFrame:
    """Packs all files below `folder` into one archive and returns files, bytes and archive_size."""
    root = os.path.abspath(folder)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    name = F.substring(F.regexp_replace("path", "^file:/*", "/"), len(root) + 2, 1 << 20)
    rows = files.select(F.lit("archive").alias("archive"), name.alias("name"), F.lit("file").alias("kind"), "content", F.unix_timestamp("modificationTime").alias("mtime"), F.lit(None).cast("int").alias("mode"))
    # Spark's file reader passes over empty files.
    empty = [os.path.relpath(os.path.join(at, f), root) for at, _, names in os.walk(root) for f in names if not os.path.getsize(os.path.join(at, f))]
    none = spark.createDataFrame([("archive", f, "file", b"", int(os.path.getmtime(os.path.join(root, f))), None) for f in empty], "archive string, name string, kind string, content binary, mtime long, mode int")
    rows = rows.unionByName(none)
    packed = pack_archives(rows, "archive", fmt, **how).persist()
    out = packed.select("files", F.octet_length("content").cast("long").alias("archive_size")).collect()
    write_files(packed.select(F.lit(os.path.basename(archive)).alias("path"), "content"), os.path.dirname(os.path.abspath(archive)))
    packed.unpersist()
    return spark.createDataFrame(out)
