"""What the corpus operators share: reading tables and cutting lineage in the shared folder."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shoal.stored import released, saved, scratch_path, scratch_root  # noqa: F401  the operators take them from here

#: Words of the contracts: runs of anything but space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Keys that may be broadcast: 16 bytes each make some 30 MB, and beyond it the join shuffles instead.
MOST_KEYS = 1_000_000


def among(df: DataFrame, keys: DataFrame, on: str, how: str = "left_semi") -> DataFrame:
    """``df`` joined with ``keys``, a saved narrow table, which is broadcast only if it has few enough rows."""
    few = keys.limit(MOST_KEYS + 1).count() <= MOST_KEYS
    return df.join(F.broadcast(keys) if few else keys, on, how)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` doesn't have, one for each of ``names``."""
    used = {c.lower() for c in df.columns}
    return [next(c for c in (f"_{n}{'_' * i}" for i in range(len(used) + 1)) if c not in used) for n in names]


def text_or_empty(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def ascii_lower(c: Column) -> Column:
    """A-Z only; lower() would also fold letters that the contracts leave alone."""
    return F.translate(c, UPPER, LOWER)


def id_crc(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, as the folds of the contracts use it."""
    return F.crc32(F.col(doc_id).cast("string"))


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the Python workers once an application, so that jobs run from any working folder."""
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        top = Path(__file__).resolve().parents[1]
        to = Path(tempfile.mkdtemp(prefix="shoal-package-")) / "shoal-package.zip"
        with zipfile.ZipFile(to, "w") as z:
            for f in sorted(top.rglob("*.py")):
                z.write(f, f.relative_to(top.parent))
        sc.addPyFile(str(to))
        _SHIPPED.add(sc.applicationId)
    return spark


def slices(batch: pa.RecordBatch, *texts: str, rows: int = 512, size: int = 1_500_000) -> Iterator[pa.RecordBatch]:
    """The batch in order, in slices of at most so many rows and bytes of text; a longer text is a slice of its own."""
    n = sum(pc.fill_null(pc.binary_length(batch[t]), 0).to_numpy(zero_copy_only=False).astype("int64") for t in texts)
    start = held = 0
    for i, own in enumerate(n.tolist()):
        if i > start and (i - start >= rows or held + own > size):
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += own
    if start < batch.num_rows:
        yield batch.slice(start)
