"""Stable entity ids: greedy matching of a document's new units to its prior ones."""

from __future__ import annotations

import itertools

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.functions.ids import mint_entity, version_of

NEW = "project_label string, doc_id string, kind string, scope string, name string, start_byte bigint, end_byte bigint, source_hash string, normalized_body_hash string"
BATCH = 10_000
SCHEMA = NEW + ", entity_id string, version_id string, match string"


def assign(prior: list[dict], new: list[dict]) -> list[dict]:
    """In the order of the new units: the same (kind, scope, name) not yet taken (of several priors the last),
    else the only free prior with that (kind, body hash), else a fresh id."""
    by_key: dict[tuple, str] = {}
    by_body: dict[tuple, list[str]] = {}
    for p in prior:
        by_key[p["kind"], p["scope"], p["name"]] = p["entity_id"]
        by_body.setdefault((p["kind"], p["normalized_body_hash"]), []).append(p["entity_id"])
    taken: set[str] = set()
    out = []
    for u in new:
        found, how = by_key.get((u["kind"], u["scope"], u["name"])), "key"
        if found is None or found in taken:
            free = [e for e in by_body.get((u["kind"], u["normalized_body_hash"]), ()) if e not in taken]
            found, how = (free[0], "body") if len(free) == 1 else (None, "minted")
        if found is None:
            found = mint_entity(u["project_label"], u["doc_id"], u["kind"], u["scope"], u["name"], u["start_byte"])
        else:
            taken.add(found)
        out.append(u | {"entity_id": found, "version_id": version_of(found, u["source_hash"], u["start_byte"], u["end_byte"]), "match": how})
    return out


def assign_identity(prior: DataFrame, new: DataFrame) -> DataFrame:
    """Prior units (doc_id, kind, scope, name, normalized_body_hash, entity_id, start_byte, end_byte) against new ones.

    The greedy rule depends on the order, so a document's units are taken together, prior ones first, as they
    come out of one sort of its partition; no more than one document is held besides a batch.
    """
    had = ["doc_id", "kind", "scope", "name", "normalized_body_hash", "entity_id", "start_byte", "end_byte"]
    has = [c.split()[0] for c in NEW.split(", ")]
    out = [c.split()[0] for c in SCHEMA.split(", ")]
    # one table with a mark: the two sides may come from one source, whose columns a cogroup would confuse
    rows = prior.select(*had, F.lit(True).alias("is_prior")).unionByName(new.select(*has, F.lit(False).alias("is_prior")), allowMissingColumns=True)
    fields = ["is_prior", "entity_id", *has]
    types = [pa.int64() if t == "bigint" else pa.string() for t in (c.split()[1] for c in SCHEMA.split(", "))]

    def batch(found: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in found], t) for c, t in zip(out, types)], names=out)

    def run(batches):
        units = (dict(zip(fields, r)) for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        done: list[dict] = []
        for _, of_doc in itertools.groupby(units, key=lambda u: u["doc_id"]):
            both: tuple[list, list] = [], []
            for u in of_doc:
                both[not u.pop("is_prior")].append(u)
            done += assign(*both)
            if len(done) >= BATCH:
                yield batch(done)
                done = []
        yield batch(done)

    # the other columns only make the order total
    ordered = rows.select(*fields).repartition("doc_id").sortWithinPartitions("doc_id", F.desc("is_prior"), F.asc_nulls_last("start_byte"), F.asc_nulls_last("end_byte"), "kind", "scope", "name", "normalized_body_hash", "entity_id", "source_hash")
    return ordered.mapInArrow(run, SCHEMA)
