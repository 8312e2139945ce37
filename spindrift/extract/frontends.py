"""The frontends by language, and the units of a table of documents.

A frontend is a function of (text, min_nodes, max_chars) that gives the rows of
``spindrift.extract.python.SCHEMA`` without doc_id. ``register`` adds one or
replaces a bundled one; it must be importable where the tasks run, or picklable.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame

from spindrift.extract import braces, python, ruby
from spindrift.extract.python import MAX_CHARS, MIN_NODES, SCHEMA

Frontend = Callable[[str, int, int], list[dict]]

#: Units in a batch of results.
BATCH_UNITS = 1000


def _braces(text: str, min_nodes: int, max_chars: int, language: str) -> list[dict]:
    return braces.extract(text, braces.LANGUAGES[language], min_nodes, max_chars)


FRONTENDS: dict[str, Frontend] = {name: partial(_braces, language=name) for name in braces.LANGUAGES} | {"python": python.extract, "ruby": ruby.extract}


def register(language: str, frontend: Frontend) -> None:
    FRONTENDS[language] = frontend


def extract(language: str | None, text: str | None, min_nodes: int = MIN_NODES, max_chars: int = MAX_CHARS) -> list[dict]:
    """The units of one document, by position; a language without a frontend has none."""
    frontend = FRONTENDS.get(language or "")
    return frontend(text or "", min_nodes, max_chars) if frontend else []


def extract_units(documents: DataFrame, min_nodes: int = MIN_NODES, max_chars: int = MAX_CHARS) -> DataFrame:
    """The units of all documents (doc_id, language, content), a flat map that shuffles nothing."""
    fields = [c.split()[0] for c in SCHEMA.split(", ")[:11]]
    rep = pa.list_(pa.struct([(k, pa.string()) for k in ("kind", "content_hash", "content", "origin")]))
    ref = pa.list_(pa.struct([("callee", pa.string()), ("snippet", pa.string()), ("line", pa.int64())]))
    types = [pa.string()] * 4 + [pa.int64()] * 5 + [pa.string()] * 2
    frontends = dict(FRONTENDS)

    def run(batches):
        for b in batches:
            rows = zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2))
            units = (u | {"doc_id": d} for d, language, t in rows if language in frontends for u in frontends[language](t.as_py() or "", min_nodes, max_chars))
            while some := list(itertools.islice(units, BATCH_UNITS)):
                cols = [pa.array([r[f] for r in some], t) for f, t in zip(fields, types)]
                cols += [pa.array([r["representations"] for r in some], rep), pa.array([r["references"] for r in some], ref)]
                yield pa.RecordBatch.from_arrays(cols, names=[*fields, "representations", "references"])

    return documents.select("doc_id", "language", "content").mapInArrow(run, SCHEMA)
