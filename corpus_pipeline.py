"""A corpus pipeline of five stages over ``documents``.

Toxic documents go; lines that an earlier document holds go from the others'
texts (n_chars follows the text); of each group of near copies the row with
the smallest id stays; documents that hold a benchmark passage go; what is left
is packed into training sequences. Every stage works on all that its predecessor
kept, and all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spindrift.llm import decontaminate as leaks
from spindrift.llm import jaccard_join as jaccard
from spindrift.llm import line_dedup as lines
from spindrift.llm import packing, toxicity
from spindrift.llm.common import checkpointed, fresh, shared_folder, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones among them, finds toxic go."""
    model = toxicity.fit(*toxicity.training_sample(docs, table(spark, sf_dir, "labels")))
    names = fresh("score", docs), fresh("predicted", docs)
    return toxicity.score(docs, model, names=names).filter(F.col(names[1]) == 0).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that a document with a smaller id holds; no document goes."""
    new = lines.apply_bitmaps(docs, lines.line_dedup(docs))
    return new.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str, broadcast_rows: int = 2_000_000) -> DataFrame:
    """One row of each group of near copies stays, that of the smallest id (null ids last).

    Rows are told apart by a 64-bit hash of id and text, so neither a null nor a
    repeated id stands for another row; of rows equal in both one stays. The
    rows to drop or to thin are counted and broadcast up to ``broadcast_rows`` of
    them, joined by a shuffle beyond.
    """
    row, drop, place = fresh("row", docs), fresh("drop", docs), fresh("place", docs)
    keyed = docs.withColumn(row, F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.coalesce("text", F.lit(""))))
    slim = keyed.select(F.col(row).alias("row"), F.col("doc_id").alias("id"), "text")
    groups = jaccard.jaccard_join(slim.select(F.col("row").alias("doc_id"), "text"))
    near = checkpointed(groups.filter("n_similar > 0").select(F.col("doc_id").alias("row"), F.col("component_id").alias("group")).distinct())
    rows = checkpointed(slim.groupBy("row").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")))
    grouped = rows.join(near, "row")
    first = grouped.groupBy("group").agg(F.min(F.struct(F.col("id").isNull().alias("x"), "id", "row"))["row"].alias("first"))
    gone = grouped.join(first, "group").filter("row <> first").select("row", F.lit(True).alias("gone"))
    marks = checkpointed(rows.join(gone, "row", "left").filter("gone OR n > 1").select(F.col("row").alias(row), F.coalesce("gone", F.lit(False)).alias(drop)))
    told = keyed.join(F.broadcast(marks) if marks.count() <= broadcast_rows else marks, row, "left")
    # a repeated row comes out once; its repetitions meet in one task, by row and not by group
    order = Window.partitionBy(row, "doc_id", "text").orderBy(F.to_json(F.struct(*docs.columns)))
    thinned = told.filter(~F.col(drop)).withColumn(place, F.row_number().over(order)).filter(F.col(place) == 1)
    return told.filter(F.col(drop).isNull()).select(*docs.columns).union(thinned.select(*docs.columns))


def drop_leaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return leaks.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece."""
    return packing.pack(packing.token_pieces(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_leaked),
    ("best_fit_packing", pack_sequences),
]

#: SQL can express neither the fitted classifier nor the packing; a test compares all stages with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each one's result written to the shared folder and read again; it goes when the next one's is there."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, last = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
        if last is not None:
            path = spark._jvm.org.apache.hadoop.fs.Path(last)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        last = f"{folder}/{k}-{name}"
    return docs
