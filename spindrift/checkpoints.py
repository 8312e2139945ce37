"""The shared folder: reliable checkpoints, and tables that are made once for each state of their source."""

from __future__ import annotations

import hashlib
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a temporary one only in local mode without it."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        where = spark.conf.get("spark.checkpoint.dir", None)
        if where is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            where = tempfile.mkdtemp(prefix="spindrift-checkpoint-")
        sc.setCheckpointDir(where)
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def source_digest(spark: SparkSession, sf_dir: str, name: str) -> str:
    """Changes with any file of a table: of their names, sizes and times."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [f"{x.getPath()}:{x.getLen()}:{x.getModificationTime()}" for x in fs.listStatus(path)]
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()[:24]
