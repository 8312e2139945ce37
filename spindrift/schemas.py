"""Explicit schemas of the stored tables. ``EPOCH`` changes with any of them."""

from __future__ import annotations

EPOCH = 2

PROJECTS = "label string, locator string, last_run_id bigint"
FILES = "project_label string, doc_id string, path string, language string, source_hash string, revision string, fingerprint string"
UNITS = (
    "unit_ix bigint, project_label string, doc_id string, relative_path string, entity_id string, version_id string, generation bigint, language_id string, kind string, name string, scope string, "
    "start_byte bigint, end_byte bigint, start_line bigint, end_line bigint, body_node_count bigint, source_hash string, normalized_body_hash string"
)
REPRESENTATIONS = "project_label string, doc_id string, version_id string, kind string, content_hash string, content string, origin string"
VECTORS = "space_id string, content_hash string, embedding array<float>, norm double"
REFERENCES = "project_label string, doc_id string, caller_version string, callee string, snippet string, line bigint"
RELATIONS = "edge_ord bigint, generation bigint, from_entity_id string, to_entity_id string, to_symbol string, kind string, resolution string, provenance string"
ENTITIES = "entity_id string, first_generation bigint, last_generation bigint"
SPACES = "space_id string, channel string, model string, dimensions int, output_dimensions int, document_prompt string, contract string"
EXECUTIONS = "model string, execution string, first_seen timestamp, last_seen timestamp"
MODELS = "model_id string, name string, revision string, pooling string, dimensions int, max_length int, normalize boolean, prompts string, file_hash string, source string"
POSTINGS = "project_label string, doc_id string, term string, version_id string, tf bigint"
LENGTHS = "project_label string, doc_id string, version_id string, len bigint"
USAGE = REPRESENTATIONS
RUNS = "run_id bigint, scope string, fingerprint string, payload_version int, base_generation bigint, state string, phase string, owner string, heartbeat double, refresh_rounds int, note string"
STAGED = "run_id bigint, project_label string, doc_id string, path string, language string, fingerprint string, action string, state string, attempts int, reused int, error string"
ANALYSES = "run string, analysis string, space_id string, created timestamp"

TABLES = {
    "projects": PROJECTS,
    "files": FILES,
    "units": UNITS,
    "representations": REPRESENTATIONS,
    "vectors": VECTORS,
    "references": REFERENCES,
    "relations": RELATIONS,
    "entities": ENTITIES,
    "spaces": SPACES,
    "executions": EXECUTIONS,
    "analyses": ANALYSES,
    "models": MODELS,
    "postings": POSTINGS,
    "lengths": LENGTHS,
    "usage": USAGE,
}

#: Order of representations in a snapshot; channels are listed alphabetically instead.
REPRESENTATION_ORDER = ["full_source", "implementation", "body", "body_without_declared_name", "signature", "documentation", "symbol", "usage", "typed_signature"]
