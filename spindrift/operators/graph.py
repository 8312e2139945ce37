"""One-hop expansion over relations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def expand_by_relations(seeds: DataFrame, relations: DataFrame, units: DataFrame, limit: int) -> DataFrame:
    """unit_ix, support of the seeds' neighbours in both directions, seeds left out.

    seeds: unit_ix, seed_rank; relations: edge_ord, from_entity_id, to_entity_id
    (null for none); units: unit_ix, entity_id (of units that share an entity the
    last counts). More touching edges first, then discovery: by seed, then edge.
    """
    at = units.filter(F.col("entity_id").isNotNull()).groupBy("entity_id").agg(F.max("unit_ix").alias("unit_ix"))
    source, target = at.select(F.col("entity_id").alias("from_entity_id"), F.col("unit_ix").alias("f")), at.select(F.col("entity_id").alias("to_entity_id"), F.col("unit_ix").alias("t"))
    edges = relations.join(source, "from_entity_id").join(target, "to_entity_id").select("edge_ord", "f", "t")
    return expand(seeds, edges, limit)


def expand(seeds: DataFrame, edges: DataFrame, limit: int) -> DataFrame:
    """The same over edges between unit indices (edge_ord, f, t); an edge from a unit to itself leads nowhere."""
    s = seeds.select(F.col("unit_ix").alias("seed"), "seed_rank")
    # seeds are a bounded head of a ranked list
    out = edges.join(F.broadcast(s), F.col("f") == F.col("seed")).select(F.col("t").alias("unit_ix"), "seed_rank", "edge_ord")
    back = edges.join(F.broadcast(s), F.col("t") == F.col("seed")).select(F.col("f").alias("unit_ix"), "seed_rank", "edge_ord")
    near = out.unionByName(back).join(F.broadcast(s.select(F.col("seed").alias("unit_ix"))), "unit_ix", "left_anti")
    found = near.groupBy("unit_ix").agg(F.count(F.lit(1)).alias("support"), F.min(F.struct("seed_rank", "edge_ord")).alias("first"))
    return found.orderBy(F.desc("support"), "first.seed_rank", "first.edge_ord", "unit_ix").limit(limit).select("unit_ix", "support", F.col("first.seed_rank").alias("seed_rank"), F.col("first.edge_ord").alias("edge_ord"))


def relations_of(relations: DataFrame, generation: int) -> DataFrame:
    """All projects' edges of one generation in their stored order."""
    return relations.filter(F.col("generation") == generation).orderBy("from_entity_id", "kind", "to_symbol", "edge_ord")


def typed_signatures(hovers: DataFrame) -> DataFrame:
    """Representation rows of a language server's hover texts (unit_ix, hover)."""
    from spindrift.functions.text import hover_text, sha256_hex

    text = hovers.select("unit_ix", hover_text("hover").alias("content")).filter("content IS NOT NULL")
    return text.select("unit_ix", F.lit("typed_signature").alias("kind"), sha256_hex("content").alias("content_hash"), "content", F.lit("derived").alias("origin"))
