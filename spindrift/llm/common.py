"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: U+0020 and U+0009 to U+000D, nothing else.
WS = r"\x20\x09-\x0D"

#: Stands for a null doc_id where an operator needs a join or sort key.
NULL_ID = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once for each row.

    Inside a lambda a plain expression would be evaluated again for every
    element; binding it as the only element of an array avoids that.
    """
    return F.transform(F.array(value), body)[0]


def scanned(items: Column, state: Column, kind: str, step) -> Column:
    """What ``step(state, item)`` puts out along an array, as an array of ``kind``; step returns the new state and an array of outputs.

    The outputs are gathered by blocks, for an array that grows by one element
    at a time is copied each time.
    """
    none, size = F.array().cast(f"array<{kind}>"), 64

    def whole(xs: Column) -> Column:
        def inner(acc: Column, x: Column) -> Column:
            s, out = step(acc["s"], x)
            return F.struct(s.alias("s"), F.concat(acc["out"], out).alias("out"))

        def outer(acc: Column, b: Column) -> Column:
            done = F.aggregate(F.slice(xs, b * size + 1, F.lit(size)), F.struct(acc["s"].alias("s"), none.alias("out")), inner)
            return let(done, lambda d: F.struct(d["s"].alias("s"), F.concat(acc["out"], F.array(d["out"])).alias("out")))

        blocks = F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / size).cast("int"))
        zero = F.struct(state.alias("s"), F.array().cast(f"array<array<{kind}>>").alias("out"))
        return F.when(F.size(xs) > 0, F.flatten(F.aggregate(blocks, zero, outer)["out"])).otherwise(none)

    return let(items, whole)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only; other letters stay as they are."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, upper, upper.lower()))


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{WS}]+"), "")


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.

    Only where it is unset (tests, a single machine) a temporary folder is taken.
    """
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


def fresh(name: str, *taken: DataFrame) -> str:
    """``name``, with underscores before it until no table has such a column."""
    names = {c.lower() for df in taken for c in df.columns}
    while name.lower() in names:
        name = "_" + name
    return name


def least_ids(rows: DataFrame, k: int, among: int | None = None) -> DataFrame:
    """doc_id: the k ids of the smallest 64-bit hash, each once, as a table of at most k rows; the same for any partitioning.

    Only ids under a bound of the hash are compared, which about two in k of all
    rows (``among``, else counted) are; the bound rises as long as too few pass.
    """
    ids = rows.select("doc_id", F.xxhash64("doc_id").alias("h")).filter("doc_id IS NOT NULL")
    n, share = ids.count() if among is None else among, 0.0
    while True:
        share = min(1.0, max(2 * share, (2 * k + 100) / max(n, 1)))
        found = ids.filter(F.col("h") < F.lit(-(2**63) + int(share * 2**64))) if share < 1 else ids
        rows_ = found.distinct().orderBy("h", "doc_id").limit(k).collect()
        if len(rows_) == k or share >= 1:
            return rows.sparkSession.createDataFrame([(r.doc_id,) for r in rows_], "doc_id bigint")


def sample_texts(docs: DataFrame, ids: DataFrame, most_chars: int, *others: str) -> list:
    """Rows of doc_id, text and ``others``, one for each of the ids (at most so many that a broadcast is small).

    Of repeated ids the smallest text is taken; texts over ``most_chars`` code
    points aren't, so the rows and their bytes are bounded.
    """
    named = docs.select("doc_id", "text", *others).filter(F.col("text").isNotNull() & (F.length("text") <= most_chars))
    least = named.join(F.broadcast(ids), ["doc_id", *[c for c in ids.columns if c != "doc_id"]]).groupBy("doc_id", *others).agg(F.min("text").alias("text"))
    return least.orderBy("doc_id", *others).collect()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
