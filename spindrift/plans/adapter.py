"""Units, representations and relations made of the plain tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.functions.ids import unit_id
from spindrift.functions.text import content_hash, tokens


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One unit for each document."""
    d, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    text = F.coalesce("text", F.lit(""))
    return d.select(
        i.alias("unit_ix"),
        F.col("source").alias("project_label"),
        F.col("lang").alias("language_id"),
        F.concat("lang", F.lit("/"), "source", F.lit("/doc_"), i.cast("string"), F.lit(".txt")).alias("relative_path"),
        F.when(i % 4 == 0, "function").when(i % 4 == 1, "method").when(i % 4 == 2, "closure").otherwise("test").alias("kind"),
        F.concat(F.when(i % 7 == 0, "test_").otherwise("unit_"), i.cast("string")).alias("name"),
        F.when(i % 3 == 0, None).when(i % 10 == 0, "tests").otherwise(F.concat(F.lit("S"), (i % 5).cast("string"))).alias("scope"),
        F.lit(0).cast("bigint").alias("start_byte"),
        F.octet_length(text).cast("bigint").alias("end_byte"),
        F.size(tokens(text)).cast("bigint").alias("body_node_count"),
        text.alias("content"),
        content_hash(text).alias("content_hash"),
    )


def with_ids(units_: DataFrame) -> DataFrame:
    return units_.withColumn("normalized_body_hash", F.col("content_hash")).withColumn("unit_id", unit_id())


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """unit_ix, embedding; units beyond the vectors' range have none."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("unit_ix"), "embedding")


def representations(units_: DataFrame) -> DataFrame:
    """Three channels: full_source and implementation of every unit, documentation of every second one."""
    base = units_.select("unit_ix", "project_label", "relative_path", "language_id", "content", "content_hash")
    doc = F.substring_index("content", "\n", 1)
    kinds = F.array(
        F.struct(F.lit("full_source").alias("kind"), F.sha2("content", 256).alias("content_hash"), F.col("content").alias("content"), F.lit("extracted").alias("origin")),
        F.struct(F.lit("implementation").alias("kind"), F.col("content_hash").alias("content_hash"), F.col("content").alias("content"), F.lit("extracted").alias("origin")),
        F.when(F.col("unit_ix") % 2 == 0, F.struct(F.lit("documentation").alias("kind"), F.sha2(doc, 256).alias("content_hash"), doc.alias("content"), F.lit("derived").alias("origin"))),
    )
    rows = base.select("unit_ix", "project_label", "relative_path", "language_id", F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("r"))
    return rows.select("unit_ix", "project_label", "relative_path", "language_id", "r.*")


def query_vector(spark: SparkSession, sf_dir: str, vec_id: int) -> list[float]:
    return list(table(spark, sf_dir, "embeddings").filter(F.col("vec_id") == vec_id).first().embedding)


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between units: a line item leads from its part's number to its supplier's."""
    li = table(spark, sf_dir, "lineitem")
    return li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("bigint").alias("edge_ord"), F.col("l_partkey").alias("f"), F.col("l_suppkey").alias("t"))
