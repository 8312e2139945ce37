"""Toxicity (operator 7): a linear classifier over character n-grams scaled by
naive Bayes log-count ratios.

A text's features are the distinct n-grams (lower-cased, white space runs as one
space, padded by a space) present in it, hashed to ``2**bits`` buckets. Each
feature's value is its log-count ratio r between toxic and other texts, positive
or negative; only buckets whose ratio stands out from chance stay. A logistic regression on these
values gives the weights, so a score is one table look-up for each distinct
bucket. Texts with no such n-gram, empty and null ones among them, score by the
bias alone; one of them, not toxic, is among the examples (``EMPTY``).

The fit takes a bounded sample: for each label the ``per_class`` labelled ids
with the smallest hash, less those with texts over ``FIT_CHARS`` code points; of
rows that repeat an id the smallest text and the largest label count. Rows with
a null text, label or doc_id are left out. Scoring covers every row and whole
texts, very long ones too. Repeated rows score alike, so ties in the score are
given out as they are. Without labels, or with one class only, the score is a
constant. An empty table gives none. Other columns stay untouched; where the
names of the results are taken, the caller names them otherwise.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import least_ids, sample_texts

PER_CLASS = 2_000
FIT_CHARS = 20_000
BITS = 22
SIZES = (4, 5, 6)
MIN_Z = 4.5
ALPHA = 0.5
#: Weight of a text without any n-gram, which isn't toxic, against all the others.
EMPTY = 0.05

_MULT = np.uint64(0x9E3779B97F4A7C15)


def held_out(doc_id: Column, mod: int = 5, rest: int = 0) -> Column:
    """Whether crc32(doc_id as text) mod ``mod`` is ``rest``; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(mod)) == rest, F.lit(False))


def ngram_buckets(text: str, sizes=SIZES, bits: int = BITS) -> np.ndarray:
    """Buckets of all n-grams of a text, repeats included, in no useful order."""
    t = " " + " ".join(text.lower().split()) + " "
    c = np.frombuffer(t.encode("utf-32-le"), "<u4").astype(np.uint64)
    out = []
    h = np.zeros(len(c), np.uint64)
    for n in range(1, max(sizes) + 1):
        if len(c) < n:
            break
        # h[i] hashes c[i : i + n]
        h = (h[: len(c) - n + 1] + c[n - 1 :] + np.uint64(n)) * _MULT
        h ^= h >> np.uint64(29)
        if n in sizes:
            out.append((h >> np.uint64(64 - bits)).astype(np.int32))
    return np.concatenate(out) if out else np.empty(0, np.int32)


def distinct(b: np.ndarray, scratch: np.ndarray) -> np.ndarray:
    """The distinct values, by the last write to each place of the scratch table."""
    i = np.arange(len(b), dtype=np.int32)
    scratch[b] = i
    return b[scratch[b] == i]


class Model:
    """Hashed weights: ``weights[bucket]`` is the log-count ratio times its coefficient."""

    def __init__(self, weights: np.ndarray, bias: float, sizes=SIZES, bits: int = BITS):
        self.at = np.flatnonzero(weights).astype(np.int32)
        self.values, self.bias, self.sizes, self.bits = weights[self.at].astype(np.float64), float(bias), tuple(sizes), bits

    def table(self) -> np.ndarray:
        """The place of each bucket among the values, 0 for none."""
        t = np.zeros(1 << self.bits, np.int32)
        t[self.at] = np.arange(1, len(self.at) + 1, dtype=np.int32)
        return t

    def score(self, text: str | None, table: np.ndarray) -> float:
        p = table[ngram_buckets(text or "", self.sizes, self.bits)]
        found = np.unique(p[p > 0]) - 1
        return 1.0 / (1.0 + float(np.exp(-(self.bias + self.values[found].sum()))))


def fit(texts: list[str], labels: list[int], sizes=SIZES, bits: int = BITS, min_z: float = MIN_Z, alpha: float = ALPHA, l2: float = 0.3) -> Model:
    """Fit on texts held in memory; with one class only, a constant model."""
    y = np.array(labels, np.float64)
    if len(y) == 0 or y.min() == y.max():
        return Model(np.zeros(1 << bits), 0.0 if len(y) == 0 else (4.0 if y[0] else -4.0), sizes, bits)
    scratch = np.zeros(1 << bits, np.int32)
    # two passes, so that only the chosen buckets of each text are ever held
    pos, neg = np.zeros(1 << bits, np.int32), np.zeros(1 << bits, np.int32)
    for t, v in zip(texts, labels):
        (pos if v else neg)[distinct(ngram_buckets(t, sizes, bits), scratch)] += 1
    n1, n0 = y.sum(), len(y) - y.sum()
    seen = np.flatnonzero(pos + neg)
    a, b = pos[seen].astype(np.float64), neg[seen].astype(np.float64)
    share = (a + b) / len(y)
    z = (a / n1 - b / n0) / np.sqrt(np.maximum(share * (1 - share), 1e-9) * (1 / n1 + 1 / n0))
    use = seen[np.abs(z) >= min_z]
    if len(use) == 0:
        return Model(np.zeros(1 << bits), float(np.log(n1 / n0)), sizes, bits)
    ratio = np.log((pos[use] + alpha) / (n1 + 2 * alpha)) - np.log((neg[use] + alpha) / (n0 + 2 * alpha))
    col = np.full(1 << bits, -1, np.int32)
    col[use] = np.arange(len(use))
    flat = []
    for t in texts:
        c = col[ngram_buckets(t, sizes, bits)]
        flat.append(np.unique(c[c >= 0]))
    ri, ci = np.repeat(np.arange(len(flat)), [len(f) for f in flat]), np.concatenate(flat)
    val = ratio[ci]
    w, b = np.zeros(len(use)), float(np.log(n1 / n0))
    # gradient descent with Nesterov momentum on the l2-penalised log loss
    lip = 0.25 * max(1.0, np.bincount(ri, val * val, len(y)).max()) + 1e-9
    vw, vb = w.copy(), b
    prev_w, prev_b, weight = w, b, np.where(y > 0, 0.5 / n1, 0.5 / n0) * len(y)
    for k in range(400):
        e = (1 / (1 + np.exp(-(np.bincount(ri, val * vw[ci], len(y)) + vb))) - y) * weight
        nw = vw - (np.bincount(ci, e[ri] * val, len(use)) / len(y) + l2 / len(y) * vw) / (lip * weight.max() + l2 / len(y))
        of_empty = EMPTY / (1 + np.exp(-vb))
        nb = vb - (e.mean() + of_empty) / (0.25 * (weight.max() + EMPTY))
        m = k / (k + 3)
        vw, vb = nw + m * (nw - prev_w), nb + m * (nb - prev_b)
        prev_w, prev_b = nw, nb
    full = np.zeros(1 << bits)
    full[use] = prev_w * ratio
    return Model(full, prev_b, sizes, bits)


def training_sample(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS, mod: int = 5, rest: int = 0):
    """(texts, labels) of the bounded sample, the same for any partitioning."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id"), mod, rest))
    known = known.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max(label).cast("int").alias("y"))
    texts, ys = [], []
    for y in (0, 1):
        rows = sample_texts(docs, least_ids(known.filter(F.col("y") == y), per_class), FIT_CHARS)
        texts += [r.text for r in rows]
        ys += [y] * len(rows)
    return texts, ys


def score(docs: DataFrame, model: Model, threshold: float = 0.5, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """The documents with a score and whether it reaches the threshold, under two names that they don't have."""
    if set(names) & set(docs.columns):
        raise ValueError(f"the table has columns {names}")
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shipped.value
        table = m.table()
        for b in batches:
            s = [m.score(t.as_py(), table) for t in b.column(b.schema.get_field_index("text"))]
            cols = list(b.columns) + [pa.array(s, pa.float64()), pa.array([int(x >= threshold) for x in s], pa.int32())]
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names + list(names))

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema)
    return docs.mapInArrow(run, f"{fields}`{names[0]}` double, `{names[1]}` int")


def toxicity(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    model = fit(*training_sample(docs, labels, per_class=per_class))
    return score(docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")), model, threshold).select("doc_id", "held_out", "score", "predicted")


def crc_mod(doc_id: int, mod: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % mod
