"""Top-k ranked search over a table of labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoal.functions.search import subsequence_score, subsequence_score_col
from shoal.stored import saved


def ranked_search(df: DataFrame, label: str, ordinal: str, needle: str, limit: int = 60, collation: str = "UNICODE") -> DataFrame:
    """The best ``limit`` rows by (score, collated label, ordinal); for an empty needle, the first by ordinal.

    The limit is the feature. Both branches plan as TakeOrderedAndProject: each task keeps ``limit`` rows.
    """
    if not needle:
        return df.orderBy(ordinal).limit(limit).withColumn("score", F.lit(0))
    scored = df.withColumn("score", subsequence_score(F.col(label), needle)).where("score is not null")
    return scored.orderBy("score", F.collate(F.col(label), collation), ordinal).limit(limit)


def mask(chars: Column) -> Column:
    """A bit for each of the characters, by their codes' last six bits: what lacks a bit lacks the character."""
    return F.aggregate(chars, F.lit(0).cast("long"), lambda m, c: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.ascii(c) % 64)))


def characters(text: Column) -> Column:
    return F.filter(F.array_distinct(F.split(F.lower(text), "")), lambda c: c != "")


#: Needles are broadcast while their texts and 100 bytes for each stay within this; beyond it the join shuffles.
MOST_BYTES = 32 << 20


def many_searches(labels: DataFrame, needles: DataFrame, label: str, ordinal: str, needle: str, limit: int = 60, collation: str = "UNICODE") -> DataFrame:
    """needle, place from 1, ordinal, label, score: for every different needle what ``ranked_search`` gives.

    Labels are indexed by their characters. A needle meets the labels that hold the rarest of its characters only, of
    these those whose mask has all its bits are scored, and each task keeps ``limit`` rows a needle (the limit is the
    feature). Of equal labels, which score alike, only the first ``limit`` by ordinal can be among these, so only they
    are indexed. The index itself is never broadcast, whatever size Spark takes it for. Null labels and needles find nothing.
    """
    wanted = needles.where(F.col(needle).isNotNull()).select(F.col(needle).alias("needle")).distinct()
    rows = labels.where(F.col(label).isNotNull()).select(F.col(ordinal).alias("ordinal"), F.col(label).alias("label"))
    copies = rows.groupBy("label").agg(F.least(F.count(F.lit(1)), F.lit(limit)).alias("copies"))
    common = copies.select("copies", F.explode(characters(F.col("label"))).alias("char")).groupBy("char").agg(F.sum("copies").alias("n"))  # a row a character
    asked = wanted.where("needle <> ''").select("needle", F.explode(characters(F.col("needle"))).alias("char"))
    rare = asked.join(F.broadcast(common), "char", "left").groupBy("needle").agg(F.min_by("char", F.coalesce("n", F.lit(0))).alias("char"))
    rare = saved(rare.withColumn("asks", mask(characters(F.col("needle")))), "rarest")
    few = (rare.agg(F.sum(F.octet_length("needle") + F.lit(100))).first()[0] or 0) <= MOST_BYTES
    among_equal = Window.partitionBy("label").orderBy("ordinal")
    firsts = rows.withColumn("place", F.row_number().over(among_equal)).where(F.col("place") <= limit)
    index = firsts.select("ordinal", "label", mask(characters(F.col("label"))).alias("has"), F.explode(characters(F.col("label"))).alias("char"))
    met = (F.broadcast(rare).join(index, "char") if few else rare.join(index.hint("merge"), "char")).where(F.col("has").bitwiseAND(F.col("asks")) == F.col("asks"))
    scored = met.select("needle", "ordinal", "label", subsequence_score_col(F.col("label"), F.col("needle")).alias("score")).where("score is not null")
    by_score = Window.partitionBy("needle").orderBy("score", F.collate(F.col("label"), collation), "ordinal")
    found = scored.withColumn("place", F.row_number().over(by_score)).where(F.col("place") <= limit)
    first = rows.orderBy("ordinal").limit(limit).withColumns({"place": F.row_number().over(Window.orderBy("ordinal")), "score": F.lit(0), "none": F.lit("")})  # at most ``limit`` rows
    empty = wanted.where("needle = ''").join(F.broadcast(first), F.col("needle") == F.col("none")).drop("none")
    return found.unionByName(empty).select("needle", "place", "ordinal", "label", F.col("score").cast("int").alias("score"))
