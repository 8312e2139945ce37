"""Incremental indexing: what changed, what to stage, what becomes garbage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

READ_ERROR = "<read-error>"


def action(live="live", seen="seen") -> Column:
    """Upsert, metadata or unchanged, for a live and an observed document as structs (null for none)."""
    a, b = F.col(live), F.col(seen)
    moved = ~a["path"].eqNullSafe(b["path"]) | ~a["language"].eqNullSafe(b["language"])
    changed = ~a["source_hash"].eqNullSafe(b["source_hash"])
    touched = ~a["revision"].eqNullSafe(b["revision"])
    return F.when(b.isNull(), "delete").when(a.isNull() | moved | changed, "upsert").when(touched, "metadata").otherwise("unchanged")


def classify(live: DataFrame, observed: DataFrame) -> DataFrame:
    """doc_id, action of every document that is live or observed.

    Both sides: doc_id, path, language, source_hash, revision. One full outer
    join on doc_id; documents that vanished are deletes.
    """
    fields = ["path", "language", "source_hash", "revision"]
    a = live.select("doc_id", F.struct(*fields).alias("live"))
    b = observed.select("doc_id", F.struct(*fields).alias("seen"))
    return a.join(b, "doc_id", "full_outer").select("doc_id", "live", "seen", action().alias("action"))


def trusted(live: DataFrame, observed: DataFrame) -> DataFrame:
    """Observed documents whose stored hash may be used again: same revision, path and language."""
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("revision", "path", "language")]
    both = live.alias("a").join(observed.alias("b"), F.col("a.doc_id") == F.col("b.doc_id"))
    return both.filter(same[0] & same[1] & same[2] & F.col("a.revision").isNotNull()).select(F.col("b.doc_id").alias("doc_id"), F.col("a.source_hash").alias("source_hash"))


def observed_hash(content: str = "content", error: str = "error") -> Column:
    """The hash of what was read, or the sentinel of a read error."""
    return F.when(F.col(error).isNotNull(), READ_ERROR).otherwise(F.sha2(F.col(content), 256))


def reconcile(staged: DataFrame, observed: DataFrame) -> DataFrame:
    """The journal after a refresh: doc_id, action, fingerprint, state, kept.

    staged: doc_id, path, language, action, fingerprint, state; observed the same
    without state. A row stays if nothing differs and it isn't being processed;
    otherwise upserts are pending and the rest is ready. Vanished rows become
    deletes that are ready.
    """
    a = staged.select("doc_id", F.struct("path", "language", "action", "fingerprint", "state").alias("a"))
    b = observed.select("doc_id", F.struct("path", "language", "action", "fingerprint").alias("b"))
    both = a.join(b, "doc_id", "full_outer")
    same = F.lit(True)
    for c in ("path", "language", "action", "fingerprint"):
        same = same & F.col("a")[c].eqNullSafe(F.col("b")[c])
    kept = F.coalesce(F.col("a").isNotNull() & F.col("b").isNotNull() & same & (F.col("a.state") != "processing"), F.lit(False))
    act = F.when(F.col("b").isNull(), "delete").otherwise(F.col("b.action"))
    state = F.when(kept, F.col("a.state")).when(act == "upsert", "pending").otherwise("ready")
    return both.select("doc_id", act.alias("action"), F.coalesce("b.fingerprint", "a.fingerprint").alias("fingerprint"), state.alias("state"), kept.alias("kept"))


def manifest_digest(manifest: DataFrame) -> DataFrame:
    """One row: the SHA-256 of the sorted lines of all but the deletes.

    Lines are hashed in 4,096 ranges of their own hash first and the range digests
    then, so no task holds the whole manifest: digest, lines.
    """
    line = F.concat_ws("\0", "doc_id", "path", "language", "fingerprint", "action")
    rows = manifest.filter(F.col("action") != "delete").select(F.sha2(line, 256).alias("h"))
    ranges = rows.groupBy(F.substring("h", 1, 3).alias("r")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), "\n"), 256).alias("d"), F.count(F.lit(1)).alias("n"))
    return ranges.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "d"))), lambda x: x["d"]), "\n"), 256).alias("digest"), F.coalesce(F.sum("n"), F.lit(0)).alias("lines"))


def pending_embeddings(representations: DataFrame, vectors: DataFrame, channel: str) -> DataFrame:
    """The distinct hashes of a channel without a vector, with one text and language each."""
    texts = channel_texts(representations.filter(F.col("kind") == channel))
    return texts.join(vectors.select("content_hash").distinct(), "content_hash", "left_anti")


def channel_texts(representations: DataFrame) -> DataFrame:
    """content_hash, language, content: the largest of each."""
    return representations.groupBy("content_hash").agg(F.max("language_id").alias("language"), F.max("content").alias("content"))


def locations(representations: DataFrame) -> DataFrame:
    """One place for each hash, the smallest by (project, path, unit); places of one document only once."""
    place = F.struct("project_label", "relative_path", "unit_ix")
    one = representations.groupBy("content_hash").agg(F.min(place).alias("p"))
    return one.groupBy("p.project_label", "p.relative_path").agg(F.min("content_hash").alias("content_hash"))


def orphan_vectors(vectors: DataFrame, representations: DataFrame, spaces: DataFrame) -> DataFrame:
    """Vectors whose (channel, hash) no live representation has; vectors: space_id, content_hash."""
    live = representations.select(F.col("kind").alias("channel"), "content_hash").distinct()
    # spaces are a catalogue of a few rows; the join is by its key either way
    return vectors.join(spaces.select("space_id", "channel"), "space_id").join(live, ["channel", "content_hash"], "left_anti").select("space_id", "content_hash")


def orphan_entities(entities: DataFrame, units: DataFrame) -> DataFrame:
    return entities.join(units.select("entity_id").distinct(), "entity_id", "left_anti")


def dangling_rows(units: DataFrame, files: DataFrame, representations: DataFrame, entities: DataFrame) -> DataFrame:
    """What a publish must find to be zero: rows whose parent is missing."""
    count = lambda df, what: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "n")
    return (
        count(units.join(files, "doc_id", "left_anti"), "units without a file")
        .union(count(representations.join(units, "unit_ix", "left_anti"), "representations without a unit"))
        .union(count(units.join(entities, "entity_id", "left_anti"), "units without an entity"))
    )


def entity_ledger(units: DataFrame) -> DataFrame:
    """First and last generation of each entity."""
    return units.groupBy("entity_id").agg(F.min("generation").alias("first_generation"), F.max("generation").alias("last_generation"))


def run_stats(documents: DataFrame) -> DataFrame:
    """Per run: documents, ready, open, failed, reused and retried ones."""
    return documents.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("documents"),
        F.count_if(F.col("state") == "ready").alias("ready"),
        F.count_if(F.col("state").isin("pending", "processing")).alias("pending"),
        F.count_if(F.col("state") == "error").alias("errors"),
        F.count_if(F.col("reused") > 0).alias("reused"),
        F.count_if(F.col("attempts") > 1).alias("retried"),
    )


def publish_report(classified: DataFrame, units: DataFrame) -> DataFrame:
    """Per project: indexed, removed, skipped documents, and units written; classified: project_label, doc_id, action."""
    docs = classified.groupBy("project_label").agg(
        F.count_if(F.col("action") == "upsert").alias("indexed"),
        F.count_if(F.col("action") == "delete").alias("removed"),
        F.count_if(F.col("action").isin("unchanged", "metadata")).alias("skipped"),
    )
    total = units.groupBy("project_label").agg(F.count(F.lit(1)).alias("total_units"))
    return docs.join(total, "project_label", "left").withColumn("total_units", F.coalesce("total_units", F.lit(0)))


def validate_documents(documents: DataFrame) -> DataFrame:
    """Violations: what, value, n. Ids and paths must be present and unique."""
    out = None
    for c in ("doc_id", "path"):
        text = F.col(c).cast("string")
        empty = documents.filter(F.coalesce(text, F.lit("")) == "").agg(F.count(F.lit(1)).alias("n")).filter("n > 0").select(F.lit(f"empty {c}").alias("what"), F.lit("").alias("value"), "n")
        twice = documents.filter(F.coalesce(text, F.lit("")) != "").groupBy(text.alias("value")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.lit(f"repeated {c}").alias("what"), "value", "n")
        out = empty.union(twice) if out is None else out.union(empty).union(twice)
    return out
