"""Distance fields over a pixel table (x, y), as arithmetic on columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def pixels(spark: SparkSession, width: int, height: int) -> DataFrame:
    """One row a pixel, from one range, so that it needs no join."""
    n = F.col("id")
    return spark.range(width * height).select((n % width).cast("double").alias("x"), F.floor(n / width).cast("double").alias("y"))


def clip01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def segment_distance(x: Column, y: Column, ax: float, ay: float, bx: float, by: float) -> Column:
    """From a point to a segment; a segment of no length is its point."""
    dx, dy = float(bx - ax), float(by - ay)
    square = dx * dx + dy * dy
    t = clip01(((x - ax) * dx + (y - ay) * dy) / square) if square else F.lit(0.0)
    return F.hypot(x - (t * dx + ax), y - (t * dy + ay))


def nearest_segment(x: Column, y: Column, segments: list[tuple[float, float, float, float]]) -> Column:
    """The least of the distances to some segments, at least one."""
    each = [segment_distance(x, y, *s) for s in segments]
    return F.least(*each) if len(each) > 1 else each[0]


def rounded_box_distance(x: Column, y: Column, left: float, top: float, right: float, bottom: float, radius: float) -> Column:
    """From the rounded rectangle's edge, negative inside."""
    cx = F.greatest(F.lit(float(left + radius)), F.least(x, F.lit(float(right - radius))))
    cy = F.greatest(F.lit(float(top + radius)), F.least(y, F.lit(float(bottom - radius))))
    return F.hypot(x - cx, y - cy) - radius


def coverage(distance: Column) -> Column:
    return clip01(F.lit(0.5) - distance)


def blended(under: Column, over: Column, alpha: Column) -> Column:
    """A channel with a layer over it, halves rounded up; layers go on in order."""
    return F.when(alpha <= 0, under).otherwise(F.floor(over * alpha + under * (1 - alpha) + 0.5))
