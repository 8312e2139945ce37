"""Line deduplication across documents (operator 2).

The lines' keys are hashed to 128 bits, range-partitioned by hash and sorted by
(hash, document, position); one streaming pass over each range sees the first
document of every key and reports the other documents' lines. What comes back
is a compressed keep bitmap for each document, not its text.

A key that a third of all documents hold would fill one range. So each map
batch first resolves its own repeats: only the lines of the smallest document
of a key go to the key's range; the batch's other documents are certain to
lose theirs, and those rows are spread by document. A key thus reaches its
range at most once for each map batch.

Null or empty texts are one empty line. Rows with a null doc_id count as one
document that sorts first. Rows that repeat a doc_id with the same text are one
document; with another text, each text has its own bitmap, but both count as
the same document when a line is looked up. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import NULL_ID, shuffle_partitions

#: Keys shorter than this many code points never count as repeated.
MIN_KEY_CHARS = 10
#: Lines that one step of a map task holds at a time.
FLUSH_LINES = 200_000

_ROWS = "pid int, kind int, h1 bigint, h2 bigint, cid bigint, fp bigint, pos int"


def _cid() -> Column:
    return F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NULL_ID))


def _fp() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def _line_rows(n: int, min_chars: int):
    def flush(digests, cids, fps, poss, counts):
        h = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
        h1, h2 = h[:, 0], h[:, 1]
        cid, fp = np.repeat(np.array(cids, np.int64), counts), np.repeat(np.array(fps, np.int64), counts)
        pos = np.array(poss, np.int32)
        o = np.lexsort((cid, h2, h1))
        h1, h2, cid, fp, pos = h1[o], h2[o], cid[o], fp[o], pos[o]
        start = np.ones(len(o), bool)
        start[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        first = cid[np.maximum.accumulate(np.where(start, np.arange(len(o)), 0))]
        certain = cid != first
        spread = (cid.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ fp.view(np.uint64)
        place = np.where(certain, spread, h1.view(np.uint64))
        pid = ((place >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int32)
        zero = np.zeros(len(o), np.int64)
        cols = [pid, certain.astype(np.int32), np.where(certain, zero, h1), np.where(certain, zero, h2), cid, fp, pos]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["pid", "kind", "h1", "h2", "cid", "fp", "pos"])

    def run(batches):
        digest = xxhash.xxh3_128_digest
        for b in batches:
            digests, poss, cids, fps, counts = [], [], [], [], []
            for cid, fp, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                before = len(digests)
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                for pos, line in enumerate(raw.split(b"\n")):
                    k = line.strip().lower()  # of bytes: ASCII white space, A-Z
                    if len(k) >= min_chars and (len(k) >= 4 * min_chars or len(k.decode()) >= min_chars):
                        digests.append(digest(k))
                        poss.append(pos)
                if len(digests) > before:
                    cids.append(cid)
                    fps.append(fp)
                    counts.append(len(digests) - before)
                if len(digests) >= FLUSH_LINES:
                    yield flush(digests, cids, fps, poss, counts)
                    digests, poss, cids, fps, counts = [], [], [], [], []
            if digests:
                yield flush(digests, cids, fps, poss, counts)

    return run


def _stream_first(batches):
    """Rows sorted by (kind, hash, document): the lines that go."""
    last, owner = None, 0
    for b in batches:
        if not b.num_rows:
            continue
        kind, h1, h2, cid, fp, pos = (b.column(i).to_numpy() for i in range(1, 7))
        start = np.ones(len(kind), bool)
        start[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]) | (kind[1:] != kind[:-1])
        start[0] = last != (kind[0], h1[0], h2[0])
        at = np.maximum.accumulate(np.where(start, np.arange(len(kind)), -1))
        first = np.where(at >= 0, cid[np.maximum(at, 0)], owner)
        gone = (kind == 1) | (cid != first)
        last, owner = (kind[-1], h1[-1], h2[-1]), int(first[-1])
        yield pa.RecordBatch.from_arrays([pa.array(c[gone]) for c in (cid, fp, pos)], names=["cid", "fp", "pos"])


def dropped_lines(docs: DataFrame, min_key_chars: int = MIN_KEY_CHARS) -> DataFrame:
    """(cid, fp, pos) of every line that goes; fp tells apart texts under one doc_id."""
    n = shuffle_partitions(docs.sparkSession)
    rows = docs.select(_cid().alias("cid"), _fp().alias("fp"), F.encode("text", "UTF-8").alias("raw"))
    rows = rows.mapInArrow(_line_rows(n, min_key_chars), _ROWS)
    rows = rows.repartitionById(n, F.col("pid")).sortWithinPartitions("kind", "h1", "h2", "cid", "fp", "pos")
    return rows.mapInArrow(_stream_first, "cid bigint, fp bigint, pos int")


def encode_bitmap(n_lines: int, dropped) -> bytes | None:
    """zlib of one bit a line, 1 to keep; None keeps all."""
    if dropped is None or len(dropped) == 0:
        return None
    bits = np.ones(n_lines, np.uint8)
    bits[np.asarray(dropped, np.int64)] = 0
    return zlib.compress(np.packbits(bits).tobytes(), 1)


def decode_bitmap(n_lines: int, bitmap: bytes | None) -> np.ndarray:
    if bitmap is None:
        return np.ones(n_lines, bool)
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=n_lines).astype(bool)


def _bitmaps(batches):
    for b in batches:
        n, drops = b.column(2).to_pylist(), b.column(3).to_pylist()
        maps = [encode_bitmap(k, d) for k, d in zip(n, drops)]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array([len(d or ()) for d in drops], pa.int64()), pa.array(maps, pa.binary())],
            names=["cid", "fp", "n_lines", "n_dropped", "keep_bitmap"],
        )


def line_dedup(docs: DataFrame, min_key_chars: int = MIN_KEY_CHARS) -> DataFrame:
    """Keep bitmaps: cid (doc_id, null as ``NULL_ID``), fp (xxhash64 of the text),
    n_lines, n_dropped, keep_bitmap (see :func:`encode_bitmap`), one row for each
    document and text. ``apply_bitmaps`` makes texts of them.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    counts = docs.select(_cid().alias("cid"), _fp().alias("fp"), lines.cast("bigint").alias("n")).groupBy("cid", "fp").agg(F.max("n").alias("n"))
    drops = dropped_lines(docs, min_key_chars).groupBy("cid", "fp").agg(F.collect_set("pos").alias("drops"))
    return counts.join(drops, ["cid", "fp"], "left").mapInArrow(_bitmaps, "cid bigint, fp bigint, n_lines bigint, n_dropped bigint, keep_bitmap binary")


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, digest: bool = False) -> DataFrame:
    """The documents, their text replaced by the kept lines joined by newlines.

    A null text stays null when nothing goes. With ``digest`` the result is
    doc_id, n_lines, n_dropped and kept_sha256 instead.
    """
    keys = docs.withColumns({"__cid": _cid(), "__fp": _fp()})
    marks = bitmaps.select(F.col("cid").alias("__cid"), F.col("fp").alias("__fp"), F.col("n_lines").alias("__n"), F.col("n_dropped").alias("__gone"), F.col("keep_bitmap").alias("__keep"))
    if digest:
        keys = keys.select("doc_id", "text", "__cid", "__fp")
    both = keys.join(marks, ["__cid", "__fp"], "left")

    @F.pandas_udf("string")
    def kept(text, n, keep):
        return text.combine(keep, lambda t, m: t if m is None else (t, m)).combine(n, _kept_text)

    new = F.when(F.col("__keep").isNull(), F.col("text")).otherwise(kept("text", "__n", "__keep"))
    if digest:
        return both.select("doc_id", F.col("__n").alias("n_lines"), F.col("__gone").alias("n_dropped"), F.sha2(F.coalesce(new, F.lit("")), 256).alias("kept_sha256"))
    return both.withColumn("text", new).select(*docs.columns)


def _kept_text(pair, n):
    if not isinstance(pair, tuple):
        return pair
    text, bitmap = pair
    return "\n".join(x for x, k in zip(text.split("\n"), decode_bitmap(int(n), bitmap)) if k)


def kept_sha256(text: str | None) -> str:
    return hashlib.sha256((text or "").encode()).hexdigest()


ORACLE_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
dup AS (SELECT key, min(doc_id) AS owner FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
marked AS (SELECT k.*, d.owner IS NOT NULL AND d.owner <> k.doc_id AS gone FROM keyed k LEFT JOIN dup d ON k.key = d.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
