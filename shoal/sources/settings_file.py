"""Settings kept as one JSON file: coerced reads and atomic writes."""

from __future__ import annotations

import json
import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoal.functions.config import coerced


def settings_table(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path and settings of each file; files that aren't a JSON object give the defaults."""
    raw = spark.read.text(paths, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    return raw.select("path", coerced(F.col("value")).alias("settings"))


def load(spark: SparkSession, path: str) -> dict:
    """One file's settings; a missing file gives the defaults."""
    text = Path(path).read_text(errors="replace") if os.path.exists(path) else ""
    return spark.createDataFrame([(text,)], "raw string").select(coerced(F.col("raw")).alias("s")).first()["s"].asDict()


def save(spark: SparkSession, path: str, patch: dict) -> dict:
    """The stored settings with the patch, coerced as a whole and written by rename; what is written is returned.

    Coercion sees the merged object, so an invalid value in a patch gives that key's default, not its old value.
    """
    merged = json.dumps(load(spark, path) | patch)
    new = spark.createDataFrame([(merged,)], "raw string").select(coerced(F.col("raw")).alias("s")).first()["s"].asDict()
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, mode=0o700, exist_ok=True)
    handle, tmp = tempfile.mkstemp(dir=folder, prefix=".settings-")
    with os.fdopen(handle, "w") as f:  # mkstemp makes the file 0600
        json.dump(new, f, indent=2)
    os.replace(tmp, path)
    return new
