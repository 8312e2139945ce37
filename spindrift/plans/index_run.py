"""An index run: documents of a source become a new published generation."""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.checkpoints import checkpointed
from spindrift.extract.frontends import extract_units
from spindrift.extract.python import MAX_CHARS, MIN_NODES
from spindrift.functions.ids import fingerprint
from spindrift.operators.filters import apply_retention
from spindrift.operators.identity import assign_identity
from spindrift.operators.incremental import classify, validate_documents
from spindrift.sources.store import Store

STATES = ("planning", "running", "ready", "committed", "paused", "failed", "superseded", "abandoned")
#: Which states may follow each.
NEXT = {
    "planning": {"running", "failed", "superseded", "abandoned"},
    "running": {"ready", "paused", "failed", "superseded", "abandoned"},
    "ready": {"committed", "paused", "failed", "superseded", "abandoned", "running"},
    "paused": {"running", "failed", "superseded", "abandoned"},
}


def transition(state: str, to: str) -> str:
    if to not in NEXT.get(state, ()):
        raise ValueError(f"a run that is {state} can't become {to}")
    return to


def backoff_ms(attempt: int) -> int:
    return min(25 * 2 ** min(attempt, 20), 1000)


def retrying(call: Callable, attempts: int = 1):
    for n in range(attempts):
        try:
            return call()
        except OSError:
            if n + 1 == attempts:
                raise
            time.sleep(backoff_ms(n) / 1000)


def settled(documents: DataFrame, refresh: Callable[[], DataFrame] | None = None, rounds: int = 5) -> DataFrame:
    """The documents of a source, valid, readable and, with ``refresh``, the same in two listings in a row."""
    for _ in range(rounds):
        seen = checkpointed(documents)
        bad = validate_documents(seen).collect()
        if bad:
            raise ValueError("; ".join(f"{r.what}: {r.value}" for r in bad))
        failed = [r.doc_id for r in seen.filter("error IS NOT NULL").select("doc_id").limit(10).collect()]
        if failed:
            raise RuntimeError(f"the run pauses, documents can't be read: {', '.join(failed)}")
        if refresh is None:
            return seen
        again = checkpointed(refresh())
        keys = ["doc_id", "path", "revision", "source_hash"]
        if seen.select(keys).exceptAll(again.select(keys)).limit(1).count() == 0 and again.select(keys).exceptAll(seen.select(keys)).limit(1).count() == 0:
            return seen
        documents = again
    raise RuntimeError("the run pauses, the source keeps changing")


def prepare(store: Store, project: str, locator: str, seen: DataFrame, run: int, retention: str, min_nodes: int, max_chars: int, enrichers=(), actions: DataFrame | None = None) -> dict[str, DataFrame]:
    """What a run has of one project: its actions and the new rows of the documents that changed."""
    live = store.table("files").filter(F.col("project_label") == project)
    if actions is None:
        actions = checkpointed(classify(live, seen).select("doc_id", "seen", "action"))
    fresh = seen.join(actions.filter("action = 'upsert'").select("doc_id"), "doc_id")
    units = extract_units(fresh, min_nodes, max_chars)
    for enrich in enrichers:
        units = enrich(units)
    units = checkpointed(units)
    prior = store.table("units").filter(F.col("project_label") == project)
    ids = assign_identity(prior, units.withColumn("project_label", F.lit(project)).select("project_label", "doc_id", "kind", "name", "scope", "start_byte", "end_byte", "source_hash", "normalized_body_hash"))
    keyed = checkpointed(units.join(ids.select("doc_id", "start_byte", "end_byte", "kind", "entity_id", "version_id"), ["doc_id", "start_byte", "end_byte", "kind"]).join(seen.select("doc_id", F.col("path").alias("relative_path"), F.col("language").alias("language_id")), "doc_id"))
    rows = keyed.withColumns({"project_label": F.lit(project), "unit_ix": F.xxhash64("version_id"), "generation": F.lit(run).cast("bigint")})
    whole = rows.select("project_label", "doc_id", "version_id", F.inline("representations"))
    config = F.lit(f"{retention}:{min_nodes}:{max_chars}")
    return {
        "actions": actions.withColumn("project_label", F.lit(project)),
        "units": rows.drop("representations", "references"),
        "representations": apply_retention(whole, retention),
        "references": rows.select("project_label", "doc_id", F.col("version_id").alias("caller_version"), F.inline("references")),
        "texts": whole.filter("kind = 'full_source'").select("version_id", "content"),
        "files": fresh.select(F.lit(project).alias("project_label"), "doc_id", "path", "language", "source_hash", "revision", fingerprint(config, F.lit(locator), "doc_id", "path", "language", "revision", "source_hash").alias("fingerprint")),
    }


def index_projects(spark: SparkSession, store: Store, sources: dict[str, tuple[str, DataFrame]], retention: str = "full", min_nodes: int = MIN_NODES, max_chars: int = MAX_CHARS, enrichers: list[Callable[[DataFrame], DataFrame]] = (), fault: Callable[[str], None] = lambda step: None, only: str | None = None, settle: bool = True) -> dict:
    """One atomic run over several projects (label to locator and documents): all become visible, or none."""
    if only is not None:
        if only not in sources:
            raise ValueError(f"there is no project {only}")
        sources = {only: sources[only]}
    generation = store.generation
    parts = [prepare(store, p, locator, settled(docs) if settle else docs, generation + 1, retention, min_nodes, max_chars, enrichers) for p, (locator, docs) in sources.items()]
    merged = {name: reduce(DataFrame.unionByName, (x[name] for x in parts)) for name in parts[0]}
    settings = {"body_node_count_threshold": min_nodes, "retention": retention, "max_body_chars": max_chars}
    return store.publish(generation + 1, {p: locator for p, (locator, _) in sources.items()}, merged["actions"], merged["files"], merged["units"], merged["representations"], merged["references"], merged["texts"], settings, generation, fault)


def index(spark: SparkSession, store: Store, project: str, locator: str, documents: DataFrame, retention: str = "full", min_nodes: int = MIN_NODES, max_chars: int = MAX_CHARS, enrichers: list[Callable[[DataFrame], DataFrame]] = (), refresh: Callable[[], DataFrame] | None = None, rounds: int = 5, fault: Callable[[str], None] = lambda step: None) -> dict:
    """Classify the documents against the live ones, extract what changed, publish; returns the report.

    ``refresh`` lists the source again after the work; while it shows other
    documents the run goes on with those, so what is published was once the
    source's state as a whole. ``enrichers`` take and return units with their
    representations.
    """
    return index_projects(spark, store, {project: (locator, settled(documents, refresh, rounds))}, retention, min_nodes, max_chars, enrichers, fault, settle=False)


def remove(spark: SparkSession, store: Store, project: str) -> dict:
    """A run that deletes a project's documents, and its name."""
    locator = next((r.locator for r in store.table("projects").filter(F.col("label") == project).collect()), None)
    if locator is None:
        raise ValueError(f"there is no project {project}")
    generation = store.generation
    none = {name: store.table(name).limit(0) for name in ("files", "units", "representations", "references")}
    report = store.publish(generation + 1, {project: locator}, removable(store, project).withColumn("project_label", F.lit(project)), **none, base=generation)
    store.remove_project(project)
    return report


def removable(store: Store, project: str) -> DataFrame:
    """Actions that delete a project's documents."""
    live = store.table("files").filter(F.col("project_label") == project)
    return live.select("doc_id", F.lit(None).cast("struct<revision:string>").alias("seen"), F.lit("delete").alias("action"))
