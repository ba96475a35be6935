"""Which files exist, as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """path, length of all files below a folder. Spark lists folders in parallel; no file is opened. Paths are without scheme
    and host, as names of candidates are."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select(F.regexp_replace("path", r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "").alias("path"), "length")
