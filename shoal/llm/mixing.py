"""Mixing sources to target weights by hash-random order and distributed prefix sums.

Each source's documents are put in the order of a hash of their id, cut into fixed ranges of the hash, summed
a range and then a row; the budget is cut at the exact word, after whole epochs where it exceeds the source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoal.llm.common import WORD, saved, text_or_empty

#: Fixed by the contract: weights in turn by source, the mix's part of all sizes, and a source's most.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, source_size, target from (source, source_size).

    Weighted shares of the whole, none above ``most`` times its source; what is cut off goes to the others by
    weight. That fills sources in the order of the level at which each is full, and one pass finds the level.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    s = sources.withColumn("place", place).withColumn("weight", weight).withColumn("most", F.lit(float(most)) * F.col("source_size"))
    s = s.withColumn("full_at", F.col("most") / F.col("weight"))
    order = Window.orderBy("full_at", "place")
    total = F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share))
    left = total - F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    weight_left = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    s = s.withColumn("level", left / weight_left).withColumn("full", F.col("level") >= F.col("full_at"))
    level = F.min(F.when(~F.col("full"), F.struct("full_at", "place", "level"))).over(Window.partitionBy())["level"]
    return s.select("source", "source_size", F.when(F.col("full"), F.col("most")).otherwise(F.col("weight") * level).alias("target"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, taken for every row.

    Null text has size 0 and null sources are one source, the last. A source's taken words are its target rounded
    to whole words: whole epochs first, then documents by hash, the last one in part. Reruns agree; rows that
    repeat an id follow each other in the order. An empty table gives no rows. Other columns are not read.
    """
    key = F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))).alias("key")
    rows = saved(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), n_words(text_or_empty(text)).alias("size"), key), "mix-sizes")
    rows = rows.withColumn("range", F.substring("key", 1, 3))
    ranges = saved(rows.groupBy("source", "range").agg(F.sum("size").alias("words")), "mix-ranges")
    plan = targets(ranges.groupBy("source").agg(F.sum("words").alias("source_size")))
    budget = F.floor(F.col("target") + F.lit(0.5)).cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = plan.withColumn("epochs", epochs).withColumn("rest", budget - F.col("epochs") * F.col("source_size"))
    # At most 4096 ranges a source, so no task grows with a hot one.
    before = F.sum("words").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    ranges = ranges.select("source", "range", F.coalesce(before, F.lit(0)).alias("before"))
    p, r = plan.withColumnRenamed("source", "p_source"), ranges.withColumnRenamed("range", "r_range").withColumnRenamed("source", "r_source")
    r = r.join(p, F.col("r_source").eqNullSafe(F.col("p_source"))).drop("p_source")
    own = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("own", F.coalesce(F.sum("size").over(own), F.lit(0)))
    rows = rows.join(r, F.col("source").eqNullSafe(F.col("r_source")) & (F.col("range") == F.col("r_range")))
    cut = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before") - F.col("own")))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + cut).cast("long").alias("taken"))
