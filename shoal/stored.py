"""Intermediate tables in the folder that driver and executors share: shorter lineage that survives lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The cluster's shared folder from spark.checkpoint.dir. Where it is unset, an own one if driver and executors are
    one process, as in tests; on a cluster no machine-local folder will do, so that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if sc.applicationId not in _OWN:
        _OWN[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="shoal-scratch-")
    return _OWN[sc.applicationId]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder of the shared one."""
    return f"{scratch_root(spark)}/shoal/{name}-{uuid.uuid4().hex}"


#: Frees a write's shuffle files when it has ended; what is written is all that later steps read.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read again."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(FREE_SHUFFLES, "false")
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(FREE_SHUFFLES, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def released(*tables: DataFrame) -> None:
    """Deletes tables of ``saved`` whose last reader's result is itself saved."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t.saved_at)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
