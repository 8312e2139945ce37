"""Hybrid retrieval: dense, compressed dense and lexical lists, fused, widened along relations and fused again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.checkpoints import checkpointed
from spindrift.functions.ids import location
from spindrift.operators.filters import WhereFilter
from spindrift.operators.fusion import K, fuse, ranked
from spindrift.operators.graph import expand
from spindrift.operators.lexical import lexical_list
from spindrift.operators.ranking import search_vector

WEIGHTS = {"dense": 1.0, "dense-compressed": 0.7, "lexical": 1.0, "graph": 0.5}
MODES = ("hybrid", "dense", "lexical")
SEEDS = 10


def candidate_pool(limit: int) -> int:
    return max(5 * limit, 50)


def condition_of(expression: str) -> Column:
    """The filter of a search: tests are left out unless the expression says otherwise."""
    return WhereFilter.parse(expression).with_default_tests("exclude").condition()


def hybrid_search(units: DataFrame, limit: int, query: str = "", vectors: DataFrame | None = None, dense: list[float] | None = None, compressed: list[float] | None = None, where: str = "", edges: DataFrame | None = None, mode: str = "hybrid", k: float = K, index=None) -> DataFrame:
    """unit_ix, score, matched and contributions (``source#rank``) of the best units.

    dense, compressed: the query's and the compressed query's vectors. The
    neighbours of the ten best units are cut to the pool before the filter.
    index: ranks (query, limit) from a stored lexical index; else units are scanned.
    """
    if mode not in MODES:
        raise ValueError(f"the mode is one of {', '.join(MODES)}")
    if mode == "dense" and (vectors is None or dense is None):
        raise ValueError("a dense search needs a space")
    pool, keep = candidate_pool(limit), condition_of(where)
    lists = []
    if mode != "lexical" and vectors is not None and dense is not None:
        lists.append(ranked(search_vector(units, vectors, dense, pool, keep), "dense", WEIGHTS["dense"], len(lists)))
        if compressed is not None:
            lists.append(ranked(search_vector(units, vectors, compressed, pool, keep), "dense-compressed", WEIGHTS["dense-compressed"], len(lists)))
    if mode != "dense":
        lists.append(ranked(lexical_list(units, query, pool, keep, index), "lexical", WEIGHTS["lexical"], len(lists)))
    # at most three lists of the pool's length; the checkpoint keeps their scans from running twice
    lists = [checkpointed(x) for x in lists] if edges is not None else lists
    fused = fuse(lists, k)
    if edges is not None:
        top = fused.limit(SEEDS)
        seeds = ranked(top, "seed", 1.0, 0).select("unit_ix", F.col("rank").alias("seed_rank"))
        near = expand(checkpointed(seeds), edges, pool)
        kept = near.join(units.filter(keep).select("unit_ix"), "unit_ix")
        # discovery order as a falling score
        as_hits = kept.select("unit_ix", F.struct((-F.col("support")).alias("s"), "seed_rank", "edge_ord").alias("o"))
        graph = as_hits.select("unit_ix", F.row_number().over(Window.orderBy("o", "unit_ix")).alias("rank"), F.lit("graph").alias("source"), F.lit(WEIGHTS["graph"]).alias("weight"), F.lit(len(lists)).alias("list_ord"))
        fused = fuse([*lists, graph], k)
    fused = fused.withColumn("contributions", F.transform("contributions", lambda c: F.concat(c["source"], F.lit("#"), c["rank"].cast("string"))))
    matched = fused.agg(F.count(F.lit(1)).alias("matched"))
    return fused.orderBy(F.desc("score"), "unit_ix").limit(limit).join(F.broadcast(matched), F.lit(True))


def shape_results(hits: DataFrame, units: DataFrame) -> DataFrame:
    """The hits as a response: rank order, place and name of each."""
    fields = units.select("unit_ix", location().alias("location"), "kind", "name", "scope", "start_byte", "end_byte")
    return hits.join(fields, "unit_ix").select("unit_ix", "location", "kind", "name", "scope", "start_byte", "end_byte", "score", "contributions", "matched").orderBy(F.desc("score"), "unit_ix")
