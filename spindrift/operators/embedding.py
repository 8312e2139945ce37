"""Embedding: model contracts, prompts, batch packing, the hash backend, token statistics."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.functions.text import col

BATCH_ITEMS, BATCH_CHARS, BATCH_AREA, PAGE, BODY_CAP = 256, 200_000, 16_000_000, 512, 10_000

#: Retrieval intents by id; a project's settings may add to them or replace them.
TASKS = {
    "code-search": "Retrieve code that implements what the search query asks for",
    "locate-edit-targets": "Retrieve the places in the code that a requested change would touch",
    "explain-behavior": "Retrieve code that answers a question about how the project behaves",
    "find-analogues": "Retrieve functions that do the same as the given fragment",
    "diagnose-failure": "Retrieve code, tests and settings that may explain the reported failure",
}


@dataclass(frozen=True)
class Prompts:
    """How texts are rendered: symmetric, instruction, prefixes or paired."""

    kind: str = "symmetric"
    query_template: str = "{query}"
    default_instruction: str | None = None
    query: str = ""
    document: str = ""
    tasks: dict[str, tuple[str, str]] = field(default_factory=dict)


@dataclass(frozen=True)
class Contract:
    """What gives vectors their meaning; any difference makes another space."""

    model: str
    dimensions: int
    normalize: bool = True
    max_length: int = 512
    pooling: str = "mean"
    prompts: Prompts = Prompts()


def _fill(template: str, instruction: str, text: Column) -> Column:
    """The template's placeholders replaced, the text's own braces left alone."""
    parts = template.replace("{instruction}", instruction).split("{query}")
    out = F.lit(parts[0])
    for p in parts[1:]:
        out = F.concat(out, text, F.lit(p))
    return out


def render_document(contract: Contract, text, document_prompt: str | None = None) -> Column:
    text = col(text)
    if document_prompt is not None:
        return F.concat(F.lit(document_prompt), text)
    if contract.prompts.kind == "prefixes" and contract.prompts.document:
        return F.concat(F.lit(contract.prompts.document), text)
    if contract.prompts.kind == "paired":
        raise ValueError(f"{contract.model} renders documents by task; the space needs a document prompt")
    return text


def render_query(contract: Contract, text, task: tuple[str, str] | None = None) -> Column:
    """task: id and instruction."""
    text, p = col(text), contract.prompts
    if p.kind in ("symmetric", "prefixes"):
        if task is not None:
            raise ValueError(f"{contract.model} takes no task instruction")
        return F.concat(F.lit(p.query), text) if p.kind == "prefixes" else text
    if p.kind == "instruction":
        instruction = task[1] if task else p.default_instruction
        if instruction is None:
            raise ValueError(f"{contract.model} needs a task instruction")
        return _fill(p.query_template, instruction, text)
    if task is None or task[0] not in p.tasks:
        raise ValueError(f"{contract.model} needs one of its task profiles: {', '.join(sorted(p.tasks))}")
    return F.concat(F.lit(p.tasks[task[0]][0]), text)


class Backend(Protocol):
    """A model: its contract, the length of texts and their native vectors, one batch at a time."""

    contract: Contract

    def token_counts(self, texts: list[str]) -> list[int]: ...

    def embed(self, texts: list[str]) -> np.ndarray: ...


_HASH_TOKEN = r"[\p{IsAlphabetic}\p{N}]+"


def hash_contract(dimensions: int) -> Contract:
    return Contract(f"token-hash-{dimensions}", dimensions)


#: Distinct tokens whose buckets a task remembers.
KNOWN_TOKENS = 500_000


def hash_embed(df: DataFrame, text: str, dimensions: int, key: str = "unit_ix", normalized: bool = True) -> DataFrame:
    """key and embedding: counts of hashed tokens, without a model.

    The tokens are cut inside the engine. A batch's distinct tokens are hashed once, and its rows' counts are one
    bincount, so the work grows with the tokens; nothing is shuffled.
    """

    def run(batches):
        known: dict[str, int] = {}
        for b in batches:
            # a cell of the counts for each row and bucket: rows are taken as the width allows
            for at in range(0, b.num_rows, step := max(1, (1 << 22) // dimensions)):
                part = b.slice(at, step)
                lists, n = part.column(1), part.num_rows
                words = lists.flatten().dictionary_encode()
                if len(known) > KNOWN_TOKENS:
                    known.clear()
                distinct = words.dictionary.to_pylist()
                for w in distinct:
                    if w not in known:
                        known[w] = int.from_bytes(hashlib.sha256(w.encode()).digest()[:8], "little") % dimensions
                bucket = np.fromiter((known[w] for w in distinct), np.int64, len(distinct))[words.indices.to_numpy()]
                row = np.repeat(np.arange(n), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
                v = np.bincount(row * dimensions + bucket, minlength=n * dimensions).reshape(n, dimensions)
                if normalized:
                    norm = np.sqrt((v.astype(np.float64) ** 2).sum(1, keepdims=True))
                    v = v / np.where(norm > 0, norm, 1)
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * np.int32(dimensions)), pa.array(v.astype(np.float32).ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), vectors], names=[key, "embedding"])

    found = df.select(key, F.regexp_extract_all(F.col(text), F.lit(_HASH_TOKEN), F.lit(0)).alias("words"))
    return found.mapInArrow(run, f"`{key}` {found.schema[key].dataType.simpleString()}, embedding array<float>")


class HashBackend:
    """The same on the driver or in a worker, for single queries."""

    def __init__(self, dimensions: int):
        self.contract = hash_contract(dimensions)

    def token_counts(self, texts: list[str]) -> list[int]:
        import re

        return [len(re.findall(r"[^\W_]+", t)) for t in texts]

    def embed(self, texts: list[str]) -> np.ndarray:
        import hashlib
        import re

        d = self.contract.dimensions
        out = np.zeros((len(texts), d), np.float32)
        for row, t in zip(out, texts):
            for w in re.findall(r"[^\W_]+", t):
                row[int.from_bytes(hashlib.sha256(w.encode()).digest()[:8], "little") % d] += 1
        return out


def normalized(v: np.ndarray) -> np.ndarray:
    n = np.sqrt((v.astype(np.float64) ** 2).sum(-1, keepdims=True))
    return np.where(n > 0, v / np.where(n > 0, n, 1), v).astype(np.float32)


def pack_batches(sizes: Iterable[tuple[int, int]], max_items: int = BATCH_ITEMS, max_chars: int = BATCH_CHARS, max_area: int = BATCH_AREA) -> list[int]:
    """The batch number of each (chars, tokens), longest first; one too large is a batch of its own."""
    packer = _Packer(max_items, max_chars, max_area)
    return [packer.add(c, t) for c, t in sizes]


def plan_batches(texts: DataFrame, max_items: int = BATCH_ITEMS, max_chars: int = BATCH_CHARS, max_area: int = BATCH_AREA, partitions: int | None = None) -> DataFrame:
    """content_hash, chars, tokens, batch, part; each partition (by hash) packs its own, longest first."""
    n = partitions or int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer = _Packer(max_items, max_chars, max_area)
        for f in frames:
            f["batch"] = [packer.add(c, t) for c, t in zip(f["chars"], f["tokens"])]
            yield f

    ordered = texts.select("content_hash", "chars", "tokens").repartition(n, "content_hash").sortWithinPartitions(F.desc("tokens"), "content_hash")
    return ordered.mapInPandas(run, "content_hash string, chars bigint, tokens bigint, batch bigint").withColumn("part", F.spark_partition_id())


class _Packer:
    def __init__(self, max_items: int, max_chars: int, max_area: int):
        self.limits = (max_items, max_chars, max_area)
        self.batch = self.items = self.chars = self.longest = 0

    def add(self, chars: int, tokens: int) -> int:
        items, most_chars, area = self.limits
        grown = max(self.longest, tokens)
        if self.items and (self.items + 1 > items or self.chars + chars > most_chars or (self.items + 1) * grown * grown > area):
            self.batch, self.items, self.chars, grown = self.batch + 1, 0, 0, tokens
        self.items, self.chars, self.longest = self.items + 1, self.chars + chars, grown
        return self.batch


def embed_pending(pending: DataFrame, make_backend, document_prompt: str | None = None, output_dimensions: int | None = None) -> DataFrame:
    """content_hash, embedding, norm of texts without a vector (content_hash, content), by a plug-in backend.

    ``make_backend`` is called once in each task; texts are batched longest first.
    """

    def run(batches):
        backend = make_backend()
        c = backend.contract
        for b in batches:
            hashes, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            counts = backend.token_counts(texts)
            order = sorted(range(len(texts)), key=lambda i: (-counts[i], hashes[i]))
            packer, groups = _Packer(BATCH_ITEMS, BATCH_CHARS, BATCH_AREA), {}
            for i in order:
                groups.setdefault(packer.add(len(texts[i]), counts[i]), []).append(i)
            for group in groups.values():
                v = np.asarray(backend.embed([texts[i] for i in group]), np.float32)
                if v.shape != (len(group), c.dimensions) or not np.isfinite(v).all():
                    raise ValueError(f"{c.model} returned vectors of shape {v.shape} or with values that aren't finite")
                v = normalized(v) if c.normalize else v
                if output_dimensions and output_dimensions < c.dimensions:
                    v = v[:, :output_dimensions]
                    v = normalized(v) if c.normalize else v
                norms = np.sqrt((v.astype(np.float64) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([pa.array([hashes[i] for i in group]), pa.array(list(v), pa.list_(pa.float32())), pa.array(norms)], names=["content_hash", "embedding", "norm"])

    contract = make_backend().contract
    if output_dimensions is not None and not 0 < output_dimensions <= contract.dimensions:
        raise ValueError(f"{contract.model} has {contract.dimensions} dimensions")
    rendered = pending.select("content_hash", render_document(contract, "content", document_prompt).alias("content"))
    return rendered.mapInArrow(run, "content_hash string, embedding array<float>, norm double")


def token_stats(df: DataFrame, tokens: str, by: list[str], cap: int, thresholds: tuple[int, ...] = (512, 2048)) -> DataFrame:
    """Per group: count, max, total, truncated, the counts over the thresholds and nearest-rank percentiles.

    The percentile is sorted[round(q (n - 1))]; it is read off the counts of each
    length, so a group's rows needn't meet in one task.
    """
    from pyspark.sql import Window

    sizes = df.groupBy(*by, F.col(tokens).alias("len")).agg(F.count(F.lit(1)).alias("k"))
    w = Window.partitionBy(*by)
    upto = F.sum("k").over(w.orderBy("len").rowsBetween(Window.unboundedPreceding, 0))
    marked = sizes.withColumn("upto", upto).withColumn("n", F.sum("k").over(w))
    at = lambda q: F.min(F.when(F.col("upto") > F.round(F.lit(q) * (F.col("n") - 1)), F.col("len")))
    return marked.groupBy(*by).agg(
        F.sum("k").cast("bigint").alias("n"),
        F.max("len").cast("bigint").alias("max_tokens"),
        F.sum(F.col("k") * F.col("len")).cast("bigint").alias("total_tokens"),
        F.coalesce(F.sum(F.when(F.col("len") >= cap, F.col("k"))), F.lit(0)).cast("bigint").alias("truncated"),
        *[F.coalesce(F.sum(F.when(F.col("len") > t, F.col("k"))), F.lit(0)).cast("bigint").alias(f"over_{t}") for t in thresholds],
        at(0.5).cast("bigint").alias("p50"),
        at(0.9).cast("bigint").alias("p90"),
        at(0.99).cast("bigint").alias("p99"),
    )


def padding_waste(planned: DataFrame) -> DataFrame:
    """Positions that padding adds: 1 - tokens / (rows x longest) over all batches."""
    per = planned.groupBy("part", "batch").agg(F.sum("tokens").alias("t"), (F.count(F.lit(1)) * F.max("tokens")).alias("padded"))
    return per.agg((1 - F.sum("t") / F.sum("padded")).alias("waste"))
