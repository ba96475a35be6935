"""Positional logic as window functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def neighbours(df: DataFrame, group: str, order: list[str], value: str, name: str = "neighbour") -> DataFrame:
    """The next value in order, else the previous one, else null."""
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn(name, F.coalesce(F.lead(value).over(w), F.lag(value).over(w)))


def cycled(df: DataFrame, group: str, order: list[str], value: str, delta: int, name: str = "target") -> DataFrame:
    """The value ``delta`` places on, around the group; the own value in groups of one. One place on or back is one window's
    neighbour or its other end; further ones meet by their places."""
    own, every = Window.partitionBy(group).orderBy(*order), Window.partitionBy(group)
    if abs(delta) == 1:
        whole = own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        beside, end = (F.lead, F.first) if delta == 1 else (F.lag, F.last)
        return df.withColumn(name, F.coalesce(beside(F.struct(value)).over(own), end(F.struct(value)).over(whole))[value])
    placed = df.withColumn("_at", F.row_number().over(own) - 1).withColumn("_n", F.count(F.lit(1)).over(every))
    to = placed.select(F.col(group).alias("_g"), F.col("_at").alias("_to"), F.col(value).alias(name))
    met = placed.join(to, (F.col(group) == F.col("_g")) & (F.pmod(F.col("_at") + delta, F.col("_n")) == F.col("_to")))
    return met.drop("_at", "_n", "_g", "_to")


def selected_after_close(df: DataFrame, group: str, order: list[str], value: str, closed: str) -> DataFrame:
    """Per group, the value at the closed one's index among the others, the last of them if there is none."""
    w = Window.partitionBy(group).orderBy(*order)
    placed = df.withColumn("_at", F.row_number().over(w) - 1)
    at = placed.where(closed).groupBy(group).agg(F.min("_at").alias("_closed"))
    rest = placed.where(f"not ({closed})").withColumn("_at", F.row_number().over(w) - 1).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(group)))
    return rest.join(at, group).where(F.col("_at") == F.least("_closed", F.col("_n") - 1)).select(group, F.col(value).alias("selected"))


def numbered_ids(df: DataFrame, group: str, order: list[str], prefix: str) -> DataFrame:
    """Gapless ids like t1, t2 within each group."""
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("id", F.concat(F.lit(prefix), F.row_number().over(w).cast("string")))


def changes(df: DataFrame, group: str, order: list[str], value: str) -> DataFrame:
    """Rows whose value differs from the one before in the group; the first row counts as a change."""
    w = Window.partitionBy(group).orderBy(*order)
    first = F.row_number().over(w) == 1
    return df.withColumn("_keep", first | ~F.lag(value).over(w).eqNullSafe(F.col(value))).where("_keep").drop("_keep")


def latest(df: DataFrame, group: str, order: list[str], value: str) -> DataFrame:
    """The last value of each group in order."""
    return df.groupBy(group).agg(F.max_by(value, F.struct(*order)).alias(value))


def active_changes(events: DataFrame, active: DataFrame, group: str, member: str, order: list[str], value: str) -> DataFrame:
    """Changes of ``value`` among the events of each group's active member only."""
    return changes(events.join(active.select(group, member), [group, member], "left_semi"), group, order, value)
