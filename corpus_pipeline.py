"""From raw documents to shards: language ID, near-duplicate removal, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, written as Parquet and read again as the next one's
docs. All but the last return the columns of documents. Every row is judged by itself, by a key made of all its
columns: rows that repeat an id or have none are judged like others, and equal rows are one document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoal.llm import decontamination, language_id, mixing, ngram_join, sharding
from shoal.llm.common import among, fresh, read, saved, scratch_path

#: Texts whose n-grams no learned language has to this part aren't in any of them.
LEAST_SCORE = 0.3
#: A near duplicate has 0.8 of the word 5-grams of both texts in common.
WIDTH, NUM, DEN = 5, 80, 100
SHARDS = 16


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a key of 128 bits for each different row, and that column's name. A column counts with its length, or as
    null, so that rows whose values only stand elsewhere differ."""
    (key,) = fresh(docs, "key")
    value = lambda c: F.col(c).cast("string")
    parts = [F.coalesce(F.concat(F.length(value(c)).cast("string"), F.lit(":"), value(c)), F.lit("null")) for c in docs.columns]
    return docs.withColumn(key, F.md5(F.concat_ws(",", *parts))), key


def numbered(rows: DataFrame, key: str) -> tuple[DataFrame, str]:
    """``rows`` with a number of 64 bits for each key, and that column's name; keys of one number get others."""
    num, again = fresh(rows, "num", "again")
    rows = rows.withColumn(num, F.xxhash64(key))
    same = rows.groupBy(num).agg(F.min(key).alias("a"), F.max(key).alias("b")).where("a < b").select(num, F.lit(1).alias(again))
    same = saved(same, "same-numbers")
    if same.isEmpty():
        return rows, num
    both = rows.join(F.broadcast(same), num, "left")  # some few of 10^10 rows
    return both.withColumn(num, F.when(F.col(again) == 1, F.xxhash64(key, F.lit("again"))).otherwise(F.col(num))).drop(again), num


def once(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` without those that repeat another; only repeated ones are shuffled, after one of each task."""
    again = saved(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(key), "repeated-rows")
    if again.isEmpty():
        return rows
    return among(rows, again, key, "left_anti").unionByName(among(rows, again, key).dropDuplicates([key]))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or in none of the languages that the labelled documents show, go."""
    rows, key = keyed(docs)
    got = language_id.language_id(rows, language_id.train(docs), doc_id=key)
    bad = got.where((F.col("lang_pred") == language_id.UND) | (F.col("score") < LEAST_SCORE)).select(F.col("doc_id").alias(key))
    return among(rows, saved(bad.distinct(), "rejected"), key, "left_anti").drop(key)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least id stays of each component of near duplicates, and equal rows stay once."""
    rows, key = keyed(docs)
    rows, num = numbered(rows, key)
    got = ngram_join.ngram_join(rows, WIDTH, NUM, DEN, doc_id=num).select(F.col("doc_id").alias(num), "component_id").distinct()
    got = saved(got, "row-components")
    groups = saved(got.where(F.col(num) != F.col("component_id")).select("component_id").distinct(), "near-groups")
    members = among(got, groups, "component_id").join(rows.select(num, key, F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", key).alias("place")), num)
    members = saved(members.select(key, "component_id", "place"), "near-members")
    first = members.groupBy("component_id").agg(F.min("place").alias("first"))
    gone = members.join(first, "component_id").where(F.col("place") != F.col("first")).select(key).distinct()
    return once(among(rows, saved(gone, "near-duplicates"), key, "left_anti"), key).drop(key, num)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go."""
    return decontamination.decontaminated(docs, read(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; of the one a source is cut in, the nearest number of times."""
    rows, key = keyed(docs)
    times, copy = fresh(rows, "times", "copy")
    got = mixing.mix(rows, doc_id=key)
    each = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + F.lit(0.5))).otherwise(0)
    got = saved(got.groupBy(F.col("doc_id").alias(key)).agg(F.sum(each).cast("int").alias(times)).where(F.col(times) > 0), "mix-times")
    taken = among(once(rows, key), got, key, "inner").withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times))))
    return taken.select(docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard, virtual slot and the version of the map."""
    return sharding.assigned(docs, scratch_path(spark, "slot-maps"), SHARDS)


STAGES = [("language_id", language), ("ngram_join", near_duplicates), ("decontamination", decontaminate), ("mixing", mix), ("sharding", shard)]
#: The n-gram join's components and the filters of language ID aren't SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
