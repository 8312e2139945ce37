"""Point-in-interval joins: the innermost unit around a position."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKET = 4096


def innermost(points: DataFrame, units: DataFrame, doc: str, position: str, start: str = "start", end: str = "end", bucket: int = BUCKET, by_length: bool = False, point_id: str = "ref_id", unit_id: str = "unit_ix") -> DataFrame:
    """Each point with the unit of its document that contains it (start <= position < end) most tightly.

    Units are spread over the buckets of positions that they touch, so the join
    is an equality on (document, bucket) and not a loop over all intervals.
    ``by_length`` prefers the shortest, otherwise the latest start and then the
    earliest end.
    """
    size = F.lit(bucket)
    left = points.withColumn("__b", F.floor(F.col(position) / size))
    touched = F.sequence(F.floor(F.col(start) / size), F.floor((F.col(end) - 1) / size))
    right = units.filter(F.col(start) < F.col(end)).withColumn("__b", F.explode(touched))
    met = left.join(right, [doc, "__b"]).filter((F.col(start) <= F.col(position)) & (F.col(position) < F.col(end)))
    order = [F.col(end) - F.col(start), F.col(start), F.col(unit_id)] if by_length else [F.desc(start), F.col(end), F.col(unit_id)]
    return met.withColumn("__k", F.row_number().over(Window.partitionBy(point_id).orderBy(*order))).filter("__k = 1").drop("__k", "__b")


def merge_intervals(df: DataFrame, key: str, start: str = "start", end: str = "end") -> DataFrame:
    """key, start, end of the merged intervals of each key; touching ones merge, empty ones go."""
    w = Window.partitionBy(key).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.filter(F.col(start) < F.col(end)).withColumn("__new", F.when(reach.isNull() | (F.col(start) > reach), 1).otherwise(0))
    grouped = marked.withColumn("__g", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy(key, "__g").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__g")
