"""Exact vector ranking. Orders are total: score descending, then unit index."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindrift.checkpoints import checkpointed
from spindrift.functions.vectors import dot, project

#: Bytes of vectors that one cell of a grid of blocks takes from each side.
CELL_BYTES = 256 << 20


def _query(vector: list[float]):
    return F.array(*[F.lit(float(x)) for x in vector])


def rank_candidates(candidates: DataFrame, query: list[float], threshold: float | None = None, vector: str = "embedding", ix: str = "unit_ix") -> DataFrame:
    """The candidates with score, those under the threshold left out."""
    scored = candidates.withColumn("score", dot(F.col(vector), _query(query)))
    if threshold is not None:
        scored = scored.filter(F.col("score") >= threshold)
    return scored.orderBy(F.desc("score"), ix)


def search_vector(units: DataFrame, vectors: DataFrame, query: list[float], limit: int, condition=None, dimensions: int | None = None) -> DataFrame:
    """unit_ix, score and matched (the rows before the limit); units without a vector don't count.

    vectors: unit_ix, embedding. The filter applies before any score is computed.
    """
    kept = units if condition is None else units.filter(condition)
    vec = F.col("embedding") if dimensions is None else project("embedding", dimensions)
    scored = kept.select("unit_ix").join(vectors, "unit_ix").select("unit_ix", dot(vec, _query(query)).alias("score"))
    # the count is one row; the top is a bounded heap in every task
    matched = scored.agg(F.count(F.lit(1)).alias("matched"))
    top = scored.orderBy(F.desc("score"), "unit_ix").limit(limit)
    return top.join(F.broadcast(matched), F.lit(True)).select("unit_ix", "score", "matched")


def similar_to_unit(units: DataFrame, vectors: DataFrame, unit_ix: int, limit: int, threshold: float, condition=None) -> DataFrame:
    """Query by example; only the example itself is left out."""
    row = vectors.filter(F.col("unit_ix") == unit_ix).select("embedding").first()
    if row is None:
        raise ValueError(f"unit {unit_ix} has no vector")
    kept = units.filter(F.col("unit_ix") != unit_ix) if condition is None else units.filter((F.col("unit_ix") != unit_ix) & condition)
    return rank_candidates(kept.select("unit_ix").join(vectors, "unit_ix"), list(row.embedding), threshold).select("unit_ix", "score").limit(limit)


def _blocks(vectors: DataFrame, block: int) -> DataFrame:
    """One row for each block of vectors: its number, ids and the matrix as bytes."""

    def run(batches):
        for b in batches:
            ids = b.column(0).to_numpy()
            flat = b.column(1).flatten().to_numpy(zero_copy_only=False).astype("<f4")
            rows = flat.reshape(len(ids), -1) if len(ids) else flat.reshape(0, 0)
            for at in range(0, len(ids), block):
                yield pa.RecordBatch.from_arrays([pa.array([int(ids[at])]), pa.array([ids[at : at + block].tolist()], pa.list_(pa.int64())), pa.array([rows[at : at + block].tobytes()])], names=["b", "ids", "m"])

    ordered = vectors.select("unit_ix", "embedding").repartitionByRange("unit_ix").sortWithinPartitions("unit_ix")
    return ordered.mapInArrow(run, "b bigint, ids array<bigint>, m binary")


def _grid(spark, *sides: DataFrame) -> int:
    """Groups to cut each side into, so that every pair of groups is a cell that fits a task and all cores have cells."""
    sizes = [d.agg(F.coalesce(F.sum(F.length("m")), F.lit(0)).alias("n")).first().n for d in sides]
    return max(math.ceil(math.sqrt(spark.sparkContext.defaultParallelism)), *(math.ceil(n / CELL_BYTES) for n in sizes))


def _multiply(li, lm, ri, rm):
    x, y = np.frombuffer(lm, "<f4").reshape(len(li), -1).astype(np.float64), np.frombuffer(rm, "<f4").reshape(len(ri), -1).astype(np.float64)
    return np.array(li), np.array(ri), x @ y.T


def _scores(rows) -> pa.RecordBatch:
    a, b, s = rows
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.float64())], names=["a", "b", "score"])


def similar_pairs(vectors: DataFrame, threshold: float, block: int = 1024) -> DataFrame:
    """a < b with a dot product of at least ``threshold``.

    Every pair has to be scored. The blocks are cut into groups and each pair of
    groups is a cell, so a block is copied once for each group and not for each
    block; inside a cell a task multiplies block by block. The sizes of blocks and
    groups don't change the result.
    """
    blocks = checkpointed(_blocks(vectors, block))
    n = _grid(vectors.sparkSession, blocks)
    own = F.pmod(F.xxhash64("b"), F.lit(n)).cast("int")
    left = blocks.select(own.alias("g"), F.explode(F.sequence(own, F.lit(n - 1))).alias("h"), F.col("b").alias("lb"), F.col("ids").alias("li"), F.col("m").alias("lm"))
    right = blocks.select(F.explode(F.sequence(F.lit(0), own)).alias("g"), own.alias("h"), F.col("b").alias("rb"), F.col("ids").alias("ri"), F.col("m").alias("rm"))
    met = left.join(right, ["g", "h"]).filter("g < h OR lb <= rb").select("lb", "li", "lm", "rb", "ri", "rm")

    def run(batches):
        for t in batches:
            for lb, li, lm, rb, ri, rm in zip(*(c.to_pylist() for c in t.columns)):
                x, y, s = _multiply(li, lm, ri, rm)
                i, j = np.nonzero(s >= threshold)
                a, b = x[i], y[j]
                keep = a < b if lb == rb else a != b
                yield _scores((np.minimum(a, b)[keep], np.maximum(a, b)[keep], s[i, j][keep]))

    return met.mapInArrow(run, "a bigint, b bigint, score double")


def top_k_between(sources: DataFrame, targets: DataFrame, k: int, threshold: float) -> DataFrame:
    """For each source its k best targets, itself included if it is one; sources without any have a null row.

    sources, targets: unit_ix, embedding (null for none). Both sides' blocks are
    cut into groups that meet in the cells of a grid, where a task multiplies
    block by block; a pair of blocks keeps k targets of each source, and those tied
    with the last.
    """
    have = lambda d: d.filter(F.col("embedding").isNotNull() & F.col("unit_ix").isNotNull())
    left, right = (checkpointed(_blocks(have(d), n)) for d, n in ((sources, 512), (targets, 4096)))
    n = _grid(sources.sparkSession, left, right)
    own, every = F.pmod(F.xxhash64("b"), F.lit(n)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    l_side = left.select(own.alias("g"), every.alias("h"), F.col("ids").alias("li"), F.col("m").alias("lm"))
    r_side = right.select(every.alias("g"), own.alias("h"), F.col("ids").alias("ri"), F.col("m").alias("rm"))

    def run(batches):
        for t in batches:
            for row in zip(*(c.to_pylist() for c in t.columns)):
                x, y, s = _multiply(*row)
                least = np.partition(s, -k, axis=1)[:, -k] if len(y) > k else np.full(len(x), -np.inf)
                i, j = np.nonzero((s >= least[:, None]) & (s >= threshold))
                yield _scores((x[i], y[j], s[i, j]))

    met = l_side.join(r_side, ["g", "h"]).select("li", "lm", "ri", "rm").mapInArrow(run, "a bigint, b bigint, score double")
    order = Window.partitionBy("a").orderBy(F.desc("score"), "b")
    best = met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return sources.select(F.col("unit_ix").alias("a")).join(best, "a", "left")


def page_after(hashes: DataFrame, after: str, limit: int, key: str = "content_hash") -> DataFrame:
    """Keyset pagination: the next hashes in order."""
    return hashes.filter(F.col(key) > after).orderBy(key).limit(limit)


def newest(df: DataFrame, keep: int, key: str = "id") -> DataFrame:
    """What lies beyond the newest ``keep`` rows, to be collected as garbage."""
    return df.orderBy(F.desc(key)).offset(keep)


def rerank_order(hits: DataFrame) -> DataFrame:
    """Judged hits first by their judgement, the others below in their fused order."""
    return hits.orderBy(F.col("rerank").isNull(), F.desc("rerank"), F.desc("score"), "unit_ix")


def order_snapshot(units: DataFrame) -> DataFrame:
    """Snapshot order with its position as ``unit_ix``; positions are given in ranges, without one global window."""
    keys = ["project_label", "relative_path", "start_byte", "end_byte"]
    parts = checkpointed(units.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__p", F.spark_partition_id()).withColumn("__k", F.monotonically_increasing_id()))
    counts = parts.groupBy("__p").agg(F.count(F.lit(1)).alias("n"), F.min("__k").alias("first"))
    # one row a partition
    before = counts.withColumn("base", F.sum("n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)))
    return parts.join(F.broadcast(before), "__p").withColumn("unit_ix", F.coalesce("base", F.lit(0)) + F.col("__k") - F.col("first")).drop("__p", "__k", "n", "first", "base")
