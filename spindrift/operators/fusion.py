"""Reciprocal-rank fusion of ranked lists."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindrift.functions.vectors import dot
from spindrift.operators.ranking import _query

K = 60.0


def ranked(hits: DataFrame, source: str, weight: float, order: int) -> DataFrame:
    """unit_ix, rank, source, weight, list_ord of a bounded list ordered by score, then unit."""
    w = Window.orderBy(F.desc("score"), "unit_ix")  # a list is cut to its limit before
    return hits.select("unit_ix", F.row_number().over(w).alias("rank"), F.lit(source).alias("source"), F.lit(float(weight)).alias("weight"), F.lit(order).alias("list_ord"))


def fuse(lists: list[DataFrame], k: float = K) -> DataFrame:
    """unit_ix, score and contributions (source, rank in the lists' order); a unit may stand in a list more than once."""
    rows = reduce(DataFrame.unionByName, lists)
    parts = F.array_sort(F.collect_list(F.struct("list_ord", "rank", "source")))
    out = rows.groupBy("unit_ix").agg(F.sum(F.col("weight") / (k + F.col("rank"))).alias("score"), parts.alias("c"))
    return out.select("unit_ix", "score", F.transform("c", lambda x: F.struct(x["source"].alias("source"), x["rank"].alias("rank"))).alias("contributions")).orderBy(F.desc("score"), "unit_ix")


def search_spaces(units: DataFrame, spaces: list[tuple[str, DataFrame, list[float], float]], limit: int, condition=None, k: float = K) -> DataFrame:
    """Several spaces (id, vectors, query, weight), each ranked in full, then fused.

    The rank over a whole space is found by range partitions, not in one task.
    """
    kept = (units if condition is None else units.filter(condition)).select("unit_ix")
    lists = []
    for space, vectors, query, weight in spaces:
        if not (math.isfinite(weight) and weight > 0):
            raise ValueError(f"the weight of {space} must be finite and positive")
        scored = kept.join(vectors, "unit_ix").select("unit_ix", dot("embedding", _query(query)).alias("raw"))
        lists.append(dense_rank_of(scored).select("unit_ix", "rank", "raw", F.lit(space).alias("space"), (F.lit(float(weight)) / (k + F.col("rank"))).alias("share")))
    rows = reduce(DataFrame.unionByName, lists)
    fused = rows.groupBy("unit_ix").agg(F.sum("share").alias("score"), F.array_sort(F.collect_list(F.struct("space", "rank", "raw", "share"))).alias("contributions"))
    matched = fused.agg(F.count(F.lit(1)).alias("matched"))
    return fused.orderBy(F.desc("score"), "unit_ix").limit(limit).join(F.broadcast(matched), F.lit(True))


def dense_rank_of(scored: DataFrame) -> DataFrame:
    """``rank`` by raw descending, then unit: windows over 1,024 score buckets and the buckets' offsets."""
    bucket = F.floor((1.0 - F.col("raw")) * 512).cast("bigint")
    b = scored.withColumn("__b", bucket)
    sizes = b.groupBy("__b").agg(F.count(F.lit(1)).alias("__n"))
    # unit vectors have scores from -1 to 1, so these are about a thousand rows
    base = sizes.select("__b", F.coalesce(F.sum("__n").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
    inside = F.row_number().over(Window.partitionBy("__b").orderBy(F.desc("raw"), "unit_ix"))
    return b.withColumn("__k", inside).join(base, "__b").select("unit_ix", "raw", (F.col("__k") + F.col("__base")).cast("bigint").alias("rank"))


def rerank(hits: DataFrame, judge, query: str, candidates: int = 12) -> DataFrame:
    """The first ``candidates`` hits judged by a column function (query, document) -> score, then put first."""
    w = Window.orderBy(F.desc("score"), "unit_ix")
    placed = hits.withColumn("__r", F.row_number().over(w))
    judged = placed.withColumn("rerank", F.when(F.col("__r") <= candidates, judge(F.lit(query), F.col("document"))))
    return judged.orderBy(F.col("rerank").isNull(), F.desc("rerank"), "__r").drop("__r")
