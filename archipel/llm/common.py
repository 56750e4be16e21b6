"""What the operators of this subpackage share: table access, scratch tables, text rules."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six white-space bytes that separate words.
BLANK = " \t\n\x0b\f\r"
WORD_GAP = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: The folder made where the session names none, as in tests.
_OWN_FOLDER: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not _OWN_FOLDER:
            _OWN_FOLDER.append(tempfile.mkdtemp(prefix="archipel-"))
            atexit.register(shutil.rmtree, _OWN_FOLDER[0], ignore_errors=True)
        folder = _OWN_FOLDER[0]
    return folder.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str = "table", path: str | None = None, partition_by: str | None = None) -> DataFrame:
    """`df` as a Parquet table in the shared folder, read again.

    This cuts lineage: a lost executor costs a re-read, never a recomputation.
    """
    spark = df.sparkSession
    path = path or new_path(spark, label)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._archipel_path = path
    return out


def written_in_buckets(df: DataFrame, key: str, number: int, label: str = "table") -> DataFrame:
    """`df` as a table in the shared folder, bucketed by `key`: joins on the key leave its rows where they are."""
    spark = df.sparkSession
    path = new_path(spark, label)
    name = path.rpartition("/")[2].replace("-", "_")
    df.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(number, key).saveAsTable(name)
    return spark.table(name)


def drop_written(*tables: DataFrame) -> None:
    """Removes tables made by `written` that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_archipel_path", None)
        if path:
            jvm = df.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.sc().hadoopConfiguration()).delete(where, True)


def tidy() -> None:
    """Gives freed memory back to the system: both Arrow's and the C library's allocators keep it, and Python workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; after each, memory that its work took is given back."""
    for batch in batches:
        yield batch
        del batch
        tidy()


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, everything else untouched (`lower` would also fold letters outside ASCII)."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    """The words of an already lower-cased text; null and blank texts have none."""
    parts = F.split(F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANK)), WORD_GAP)
    return F.filter(parts, lambda w: w != "")


def hash128(*columns: Column) -> list[Column]:
    """Two independent 64-bit hashes: together a 128-bit key that does not collide in practice."""
    return [F.xxhash64(*columns).alias("h1"), F.xxhash64(F.lit("second"), *columns, F.lit(1)).alias("h2")]


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def width_for(df: DataFrame, bytes_each: int, least: int = 8) -> int:
    """Partitions for a shuffle of what `df` holds: the session's number, or more where the plan's estimate of its size asks for them.

    The estimate needs no pass over the data; it sets how finely work is cut and never what comes out.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    known = size if size < 1 << 55 else 0  # sources without statistics claim the largest number
    return max(least, shuffle_width(df.sparkSession), -(-known // bytes_each))


#: So many ids (16 MB) are broadcast; more meet their rows in a shuffle join.
BROADCAST_IDS = 2_000_000


def pick(rows: DataFrame, key: str, ids: DataFrame, how: str) -> DataFrame:
    """`rows` joined with `ids` (a written table whose first column is the key) by a left_semi, left_anti or inner join.

    The ids are counted first: up to BROADCAST_IDS of them are broadcast, so that wide
    rows stay where they are.
    """
    first = ids.columns[0]
    own = ids.withColumnRenamed(first, "__pick")
    own = F.broadcast(own) if ids.count() <= BROADCAST_IDS else own
    out = rows.join(own, rows[key] == F.col("__pick"), how)
    return out.drop("__pick") if how == "inner" else out
