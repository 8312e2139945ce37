"""Identity recipes: selectors, entity and version ids, fingerprints."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from spindrift.functions.text import col, hex16


def _or_empty(c) -> Column:
    return F.coalesce(col(c), F.lit(""))


def unit_id(project="project_label", path="relative_path", start="start_byte", end="end_byte", body="normalized_body_hash", name="name", scope="scope", language="language_id") -> Column:
    """The selector of a unit; its kind is no ingredient."""
    return F.concat(F.lit("unit:"), hex16(project, path, col(start).cast("string"), col(end).cast("string"), body, name, _or_empty(scope), language))


def entity_id(project, doc, kind, scope, name, start) -> Column:
    return F.concat(F.lit("ent:"), hex16(project, doc, kind, _or_empty(scope), name, col(start).cast("string")))


def version_id(entity, source_hash, start, end) -> Column:
    return F.concat(F.lit("ver:"), hex16(entity, source_hash, col(start).cast("string"), col(end).cast("string")))


def _hex16(*parts: str) -> str:
    return hashlib.sha256("\0".join(parts).encode()).hexdigest()[:16]


def mint_entity(project: str, doc: str, kind: str, scope: str | None, name: str, start: int) -> str:
    return "ent:" + _hex16(project, doc, kind, scope or "", name, str(start))


def version_of(entity: str, source_hash: str, start: int, end: int) -> str:
    return "ver:" + _hex16(entity, source_hash, str(start), str(end))


def unit_line(unit="unit_id", project="project_label", path="relative_path", start="start_line", end="end_line", kind="kind", name="name", scope="scope") -> Column:
    head = F.format_string("%s %s:%s:%d-%d %s %s", col(unit), col(project), col(path), col(start).cast("bigint"), col(end).cast("bigint"), col(kind), col(name))
    return F.concat(head, F.when(col(scope).isNotNull(), F.concat(F.lit(" ("), col(scope), F.lit(")"))).otherwise(""))


def location(project="project_label", path="relative_path") -> Column:
    return F.concat_ws(":", col(project), col(path))


def fingerprint(config, provider, doc, path, language, revision, source_hash) -> Column:
    """Of a document under a run's configuration."""
    fields = F.struct(*[c.alias(n) for n, c in zip(("config", "provider", "id", "path", "language", "revision", "source_hash"), map(col, (config, provider, doc, path, language, revision, source_hash)))])
    return F.sha2(F.to_json(fields, {"ignoreNullFields": "false"}), 256)


def config_fingerprint(config: dict) -> str:
    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def database_key(root: str) -> str:
    """The default storage key of a project root."""
    return hashlib.sha256(root.encode()).digest()[:8].hex()
