"""Document revisions as a stream: each batch of new files is merged by the latest revision and published."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

REVISIONS = "doc_id string, path string, language string, revision string, content string, ts timestamp"


def latest(revisions: DataFrame) -> DataFrame:
    """The last revision of each document in a batch; equal times go by revision."""
    w = Window.partitionBy("doc_id").orderBy(F.desc("ts"), F.desc("revision"))
    return revisions.withColumn("__k", F.row_number().over(w)).filter("__k = 1").drop("__k")


def run_available(spark: SparkSession, folder: str, checkpoint: str, publish: Callable[[DataFrame, int], None], max_files: int | None = None) -> int:
    """Publish all revision files that have come since the last call; returns how many batches.

    A batch that is run again after a failure has the same number, so ``publish``
    can tell that it has done it.
    """
    done = []

    def one(batch: DataFrame, number: int) -> None:
        rows = latest(batch)
        rows = rows.withColumns({"source_hash": F.sha2("content", 256), "error": F.lit(None).cast("string")})
        publish(rows, number)
        done.append(number)

    source = spark.readStream.schema(REVISIONS)
    if max_files:
        source = source.option("maxFilesPerTrigger", max_files)
    query = source.parquet(folder).writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return len(done)


def activity(events: DataFrame, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts by window and type of an event stream; rows later than the watermark are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", every), "event_type").agg(F.count(F.lit(1)).alias("n"))
