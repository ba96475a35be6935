"""Ordered operators over keys of any size: positions, running sums, and the last or next value.

Rows are dealt to range partitions of (key, order), so that a hot key spreads over as many as it fills. Windows run inside
a partition; what a key passes from one partition to the next is a row for each partition that the key touches, and
only keys at a partition's edge touch more than one: at most three rows a partition, which may be broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoal.stored import saved

PART = "_part"


def ranged(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``df`` with the number of each row's range partition, stored, so that all that follows sees the same partitions."""
    return saved(df.repartitionByRange(key, *order).withColumn(PART, F.spark_partition_id()), "ranged")


def passed_on(rows: DataFrame, key: str, parts: list[Column]) -> DataFrame:
    """``parts`` aggregated by partition and key, for the keys that touch more partitions than one."""
    ends = rows.groupBy(PART).agg(F.min(F.struct(key)).alias("a"), F.max(F.struct(key)).alias("b"))
    edge = ends.select(F.explode(F.array("a", "b")).alias("_edge")).distinct()
    own = rows.join(F.broadcast(edge), F.col(key).eqNullSafe(F.col(f"_edge.{key}")), "left_semi")
    return own.groupBy(PART, key).agg(*parts)


def received(rows: DataFrame, before: DataFrame, key: str) -> DataFrame:
    """``rows`` with what ``before`` says of their partition and key."""
    other = before.select(F.col(PART).alias("_p"), F.col(key).alias("_k"), *[c for c in before.columns if c not in (PART, key)])
    return rows.join(F.broadcast(other), (F.col(PART) == F.col("_p")) & F.col(key).eqNullSafe(F.col("_k")), "left").drop("_p", "_k")


def scanned(df: DataFrame, key: str, order: list[str], pos: str = "pos", sums: dict[str, str] | None = None) -> DataFrame:
    """``df`` with ``pos``, each row's place within its key from 0, and for each entry name: column of ``sums`` the sum of
    the column over the key's rows before. Rows of equal order get places in no certain order; nulls add nothing."""
    sums = sums or {}
    rows = ranged(df, key, order)
    w = Window.partitionBy(PART, key).orderBy(*order)
    prior = w.rowsBetween(Window.unboundedPreceding, -1)
    totals = passed_on(rows, key, [F.count(F.lit(1)).alias("_n"), *[F.coalesce(F.sum(c), F.lit(0)).alias(f"_s_{name}") for name, c in sums.items()]])
    above = Window.partitionBy(key).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(PART, key, *[F.sum(c).over(above).alias(c) for c in totals.columns if c not in (PART, key)])
    local = rows.withColumn(pos, (F.row_number().over(w) - 1).cast("long")).withColumns({name: F.coalesce(F.sum(c).over(prior), F.lit(0)) for name, c in sums.items()})
    out = received(local, before, key)
    out = out.withColumns({name: F.col(name) + F.coalesce(c, F.lit(0)) for name, c in [(pos, F.col("_n")), *[(name, F.col(f"_s_{name}")) for name in sums]]})
    return out.drop(PART, "_n", *[f"_s_{name}" for name in sums])


def carried(df: DataFrame, key: str, order: list[str], value: str, name: str, ahead: bool = False) -> DataFrame:
    """``df`` with ``name``: the last value of its key that isn't null, up to each row, or with ``ahead`` the next one from
    it on. ``order`` must tell rows of a key apart as far as their values differ."""
    rows = ranged(df, key, order)
    way = F.desc if ahead else F.asc
    pick = F.min_by if ahead else F.max_by
    some = F.when(F.col(value).isNotNull(), F.struct(*order))
    ends = passed_on(rows, key, [pick(value, some).alias("_end")])
    above = Window.partitionBy(key).orderBy(way(PART)).rowsBetween(Window.unboundedPreceding, -1)
    before = ends.select(PART, key, F.last("_end", ignorenulls=True).over(above).alias("_before"))
    w = Window.partitionBy(PART, key).orderBy(*map(way, order)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = rows.withColumn(name, F.last(value, ignorenulls=True).over(w))
    return received(local, before, key).withColumn(name, F.coalesce(name, "_before")).drop(PART, "_before")


def as_of(rows: DataFrame, changes: DataFrame, key: str, at: str, value: str, tie: list[str] | None = None) -> DataFrame:
    """``rows`` with ``value`` of the last of ``changes`` of their key at or before their time, null if there is none.

    Of changes of one time the last by ``tie`` counts. A change whose value is null is one to null: it ends the one before.
    Rows whose key or time is null get null.
    """
    tie = tie or []
    own = [c for c in rows.columns if c != value]
    ties = [f"_tie{i}" for i in range(len(tie))]
    none = [F.lit(None).cast(changes.schema[t].dataType).alias(n) for t, n in zip(tie, ties, strict=True)]
    change = changes.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(F.col(key).alias(key), F.col(at).alias(at), F.lit(0).alias("_row"), *[F.col(t).alias(n) for t, n in zip(tie, ties, strict=True)], F.struct(F.col(value).alias("value")).alias("_set"))
    asked = rows.select(*own, F.lit(1).alias("_row"), *none)
    both = asked.unionByName(change, allowMissingColumns=True)
    found = carried(both, key, [at, "_row", *ties], "_set", "_now").where("_row = 1")
    known = F.col(key).isNotNull() & F.col(at).isNotNull()
    return found.select(*own, F.when(known, F.col("_now.value")).alias(value))


def next_from(rows: DataFrame, key: str, at: str, order: list[str], want: Column, take: Column, name: str) -> DataFrame:
    """``rows`` with ``name``: ``take`` of the first row of the key, by (at, order), whose ``at`` is ``want`` or more."""
    there = rows.select(F.col(key).alias(key), F.col(at).alias("_at"), F.lit(1).alias("_kind"), *[F.col(c).alias(f"_o_{c}") for c in order], take.alias("_take"))
    asked = rows.withColumn("_at", want).withColumn("_kind", F.lit(0))
    both = asked.unionByName(there, allowMissingColumns=True)
    found = carried(both, key, ["_at", "_kind", *[f"_o_{c}" for c in order]], "_take", name, ahead=True)
    return found.where("_kind = 0").select(*rows.columns, name)
