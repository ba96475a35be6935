"""Exact dedup by content-defined chunk recipes.

Texts are cut where their own content says so (sentence and line ends beyond a least length, a length cap
where none comes), so that shared passages become shared chunks. A document then is its recipe, the ordered
list of its chunks' identifiers, and equal recipes mean equal texts. Documents move as recipes of 16 bytes a
chunk; their text is shuffled once, chunk by chunk, to verify the identifiers, and copies fold map-side there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoal.llm.common import saved, text_or_empty

#: At least 128 characters up to a sentence or line end within 1024, else whatever is left within 1024.
CHUNK = r"(?s).{128,1023}?[\n.!?。]|.{1,1024}"
SALTS = (1, 2, 3, 4)


def chunks(text: Column) -> Column:
    """The ordered chunks; joined they are the text. An empty text has none."""
    return F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0))


def identifier(chunk: Column, salt: int) -> list[Column]:
    return [F.xxhash64(F.lit(salt), chunk), F.xxhash64(chunk, F.lit(-salt))]


def unverified(docs: DataFrame, text: str, salt: int) -> DataFrame:
    """Identifiers that stand for more than one distinct chunk of the corpus."""
    each = docs.select(F.explode(chunks(text_or_empty(text))).alias("chunk"))
    a, b = identifier(F.col("chunk"), salt)
    distinct = each.groupBy(a.alias("a"), b.alias("b"), "chunk").agg(F.count(F.lit(1)).alias("n"))
    return distinct.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def verified_salt(docs: DataFrame, text: str) -> int:
    """The first salt under which every identifier stands for one chunk; 128 bits make the first one do."""
    for salt in SALTS:
        if unverified(docs, text, salt).isEmpty():
            return salt
    raise ValueError("no salt gives each chunk an identifier of its own")


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, n_chunks for every row.

    Null text counts as empty, and empty texts are copies of each other. The largest id of a group stays; null
    ids count as smallest, and a group of only null ids has a null keep_id and keeps all its rows. Rows that
    repeat id and text are the same row and share its mark. An empty table gives no rows. Other columns,
    whatever their names, are not read.
    """
    salt = verified_salt(docs, text)
    body = text_or_empty(text)
    parts = chunks(body)
    recipe = F.concat(F.transform(parts, lambda c: identifier(c, salt)[0]), F.transform(parts, lambda c: identifier(c, salt)[1]))
    rows = saved(docs.select(F.col(doc_id).alias("doc_id"), recipe.alias("recipe"), F.sha2(body, 256).alias("text_sha256")), "recipes")
    groups = rows.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    # Written first: the join then deals both sides out itself, and adaptive execution can split a hot recipe.
    groups = saved(groups.where("group_size > 1"), "recipe-groups")
    found = rows.join(groups.withColumn("many", F.lit(True)), "recipe", "left")
    keep = F.when(F.col("many"), F.col("keep_id")).otherwise(F.col("doc_id"))
    return found.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        "text_sha256",
        (F.size("recipe") / 2).cast("int").alias("n_chunks"),
    )
