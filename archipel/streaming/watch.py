"""A folder of archives as a stream: new archives are listed as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from archipel.sources.archives import entries_of


def watch(spark: SparkSession, folder: str, **how) -> DataFrame:
    """A streaming DataFrame of the entries of every archive that appears in `folder`."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    return entries_of(files, **how)
