"""Best-fit packing by sum of squares (operator 9).

Documents become token ids with one end id; those longer than a sequence are
cut, the first piece taking the remainder. Pieces are then placed one by one:
of all open bins with room, and a new one, the choice is where the sum over
gaps of the squared number of open bins with that gap becomes smallest. The
state is one count for each gap, so a shard of any length packs in bounded
memory but for the list of its open bins.

Shards hold about ``SHARD_PIECES`` pieces, spread by hash; their number follows
the corpus, and the few bins that stay open at each shard's end are the price
(see README for the measured loss). A null or empty text is the end id alone.
Repeated rows are packed each; a null doc_id stays null.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import checkpointed

SEQUENCE = 2048
SHARD_PIECES = 60_000
END_ID = 0


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def load_encoder(path: str):
    """An encoder with the ids of ``tokenizers`` for a byte-level BPE file.

    The file's vocabulary lists its tokens in the order of the merges, so merging
    by rank gives the same ids; it is several times faster than the library that
    the file is meant for, and the tests compare the two.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in plain}
    byte |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(byte[c] for c in tok): i for tok, i in spec["model"]["vocab"].items() if tok not in special}
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    enc = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
    names = tuple(special)

    def encode(text: str) -> list[int]:
        if any(s in text for s in names):
            return enc.encode(text, allowed_special="all")
        return enc.encode_ordinary(text)

    return encode


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids."""
    first = n % size or size
    return [(0, min(first, n))] + [(s, size) for s in range(first, n, size)]


def _pieces(path: str, size: int, end_id: int, with_ids: bool):
    def run(batches):
        encode = load_encoder(path)
        for b in batches:
            out: list[list] = [[] for _ in range(6)]
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = np.array(encode(text.as_py() or "") + [end_id], "<u4")
                for k, (start, length) in enumerate(cut(len(ids), size)):
                    part = ids[start : start + length]
                    for col, v in zip(out, (doc, k, start, length, zlib.crc32(part.tobytes()), part.astype(np.int64) if with_ids else None)):
                        col.append(v)
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
            names = ("doc_id", "piece", "start", "length", "ids_crc32", "ids")
            k = 6 if with_ids else 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out[:k], types)], names=list(names[:k]))

    return run


def token_pieces(docs: DataFrame, path: str | None = None, size: int = SEQUENCE, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, the ids of every piece."""
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + (", ids array<bigint>" if with_ids else "")
    src = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return src.mapInArrow(_pieces(path or vocabulary_path(), size, end_id, with_ids), schema)


class SumOfSquares:
    """Online packing into bins of ``size``; ``place`` returns (bin, offset)."""

    def __init__(self, size: int = SEQUENCE):
        self.size, self.bins = size, 0
        self.count = np.zeros(size + 1, np.int64)  # open bins by gap; gap 0 is full and doesn't count
        self.cost = np.zeros(size + 1, np.int64)
        self.open: list[list[int]] = [[] for _ in range(size + 1)]

    def place(self, length: int) -> tuple[int, int]:
        n, size = self.count, self.size
        # moving a bin from gap g to g - length changes the sum by 2 (n[g - length] - n[g] + 1), or 1 - 2 n[g] when it fills up
        change = 2 * (n[: size + 1 - length] - n[length:] + 1)
        change[0] = 1 - 2 * n[length]
        change[n[length:] == 0] = 1 << 60
        new = 2 * n[size - length] + 1 if length < size else 0
        g = int(change.argmin()) + length
        if change[g - length] <= new:
            which = self.open[g].pop()
            n[g] -= 1
        else:
            g, which = size, self.bins
            self.bins += 1
        if g > length:
            self.open[g - length].append(which)
            n[g - length] += 1
        return which, size - g


def _pack(size: int):
    def run(batches):
        packer = SumOfSquares(size)
        for b in batches:
            shard = b.column(b.schema.get_field_index("__shard"))
            lengths = b.column(b.schema.get_field_index("length")).to_pylist()
            placed = [packer.place(k) for k in lengths]
            base = shard.to_numpy().astype(np.int64) << 40
            seq = base + np.array([p[0] for p in placed], np.int64)
            keep = [i for i, n in enumerate(b.schema.names) if not n.startswith("__")]
            cols = [b.column(i) for i in keep] + [pa.array(seq), pa.array([p[1] for p in placed], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=[b.schema.names[i] for i in keep] + ["sequence_id", "offset"])

    return run


def pack(pieces: DataFrame, size: int = SEQUENCE, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """The pieces (checkpointed, for they are read twice) with sequence_id and offset.

    Each shard packs in the order of falling length, equal ones by hash.
    """
    pieces = checkpointed(pieces)
    shards = max(1, -(-pieces.count() // shard_pieces))
    mark = F.xxhash64("doc_id", "piece", "ids_crc32")
    rows = pieces.withColumn("__mark", mark).withColumn("__shard", F.pmod(F.col("__mark"), F.lit(shards)).cast("int"))
    rows = rows.repartitionById(shards, F.col("__shard")).sortWithinPartitions("__shard", F.desc("length"), "__mark")
    out = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id bigint, offset bigint"
    return rows.mapInArrow(_pack(size), out)

