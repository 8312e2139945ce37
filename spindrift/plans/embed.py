"""Embedding of whole spaces: what is pending is found, recovered, embedded and inserted."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.checkpoints import checkpointed
from spindrift.extract.frontends import extract_units
from spindrift.operators import embedding as E
from spindrift.operators.filters import embeddable_channels
from spindrift.sources import read
from spindrift.sources.store import Store


def contract_text(contract: E.Contract, document_prompt: str | None, output_dimensions: int | None) -> str:
    """All that gives a space's vectors their meaning, as text."""
    return json.dumps(asdict(contract) | {"document_prompt": document_prompt, "output_dimensions": output_dimensions}, sort_keys=True)


def check_contract(row, contract: E.Contract, document_prompt: str | None = None) -> None:
    """A query's or a run's model must be the one that made the space."""
    if row.contract != contract_text(contract, document_prompt if document_prompt is not None else row.document_prompt, row.output_dimensions):
        raise ValueError(f"the space {row.space_id} was made by {row.model}, not by {contract.model} as it is now")


def recover_channel_texts(store: Store, documents: DataFrame | None, hashes: DataFrame) -> DataFrame:
    """content_hash and content of hashes whose text wasn't kept: the documents are extracted again with the store's own settings."""
    if documents is None:
        return store.spark.createDataFrame([], "content_hash string, content string")
    nodes, chars = store.setting("body_node_count_threshold") or E.BODY_CAP // 1000, store.setting("max_body_chars") or E.BODY_CAP
    rows = extract_units(documents, nodes, chars).select(F.inline("representations")).select("content_hash", "content")
    return rows.join(hashes.select("content_hash").distinct(), "content_hash", "left_semi").groupBy("content_hash").agg(F.max("content").alias("content"))


def embed_space(store: Store, space_id: str, channel: str, make_backend: Callable[[], E.Backend], document_prompt: str | None = None, output_dimensions: int | None = None, documents: DataFrame | None = None) -> dict:
    """Embed what a space lacks; returns how many hashes were pending, recovered and inserted.

    The space is recorded with its contract, or must have been with the same one.
    Texts that were not kept are recovered from ``documents`` (doc_id, language,
    content); those that can't be stay pending.
    """
    contract = make_backend().contract
    store.find_or_create_model({"name": contract.model, "pooling": contract.pooling, "dimensions": contract.dimensions, "max_length": contract.max_length, "normalize": contract.normalize, "prompts": json.dumps(asdict(contract.prompts), sort_keys=True), "source": "plug-in"})
    store.find_or_create_space({
        "space_id": space_id, "channel": channel, "model": contract.model, "dimensions": contract.dimensions, "output_dimensions": output_dimensions, "document_prompt": document_prompt,
        "contract": contract_text(contract, document_prompt, output_dimensions),
    })
    store.record_execution(contract.model, "worker")
    own = store.table("representations").filter(F.col("kind") == channel).groupBy("content_hash").agg(F.max("content").alias("content"))
    have = store.table("vectors").filter(F.col("space_id") == space_id)
    pending = checkpointed(own.join(have.select("content_hash"), "content_hash", "left_anti"))
    missing = pending.filter("content IS NULL")
    n, lost = pending.count(), missing.count()
    recovered = checkpointed(recover_channel_texts(store, documents, missing)) if lost else None
    texts = pending.filter("content IS NOT NULL") if recovered is None else pending.filter("content IS NOT NULL").unionByName(recovered)
    vectors = E.embed_pending(texts, make_backend, document_prompt, output_dimensions).withColumn("space_id", F.lit(space_id))
    added = store.insert_vectors(checkpointed(vectors), output_dimensions or contract.dimensions) if n else 0
    return {"space": space_id, "pending": n, "recovered": recovered.count() if recovered is not None else 0, "inserted": added}


def embed_channels(store: Store, make_backend: Callable[[], E.Backend], documents: DataFrame | None = None) -> list[dict]:
    """One space ``default/<channel>`` for each channel that can be embedded."""
    channels = [r.kind for r in embeddable_channels(store.table("representations")).collect()]
    return [embed_space(store, f"default/{c}", c, make_backend, documents=documents) for c in channels]


def search_text(store: Store, space_id: str, text: str, backend: E.Backend, limit: int, task: tuple[str, str] | None = None, condition=None) -> DataFrame:
    """unit_ix and score of the units nearest to a text in a space, if the backend is the space's."""
    from spindrift.operators.ranking import rank_candidates

    tables = store.snapshot()
    row = read.space(tables, space_id)
    check_contract(row, backend.contract)
    rendered = store.spark.range(1).select(E.render_query(backend.contract, F.lit(text), task).alias("t")).first().t
    v = backend.embed([rendered]).astype("float32")
    v = E.normalized(v) if backend.contract.normalize else v
    if row.output_dimensions and row.output_dimensions < backend.contract.dimensions:
        v = v[:, : row.output_dimensions]
        v = E.normalized(v) if backend.contract.normalize else v
    indexed = read.index_of_space(tables, space_id).filter("embedding IS NOT NULL")
    if condition is not None:
        indexed = indexed.join(tables["units"].filter(condition).select("version_id"), "version_id", "left_semi")
    return rank_candidates(indexed, v[0].tolist()).select("unit_ix", "score").limit(limit)
