"""Quality classifier from weak labels (operator 6).

Overlapping heuristic labellers vote good (1), bad (0) or not at all on every
document. Expectation-maximisation over the vote patterns estimates each
labeller's accuracy for either class and the classes' shares; the patterns and
their counts, gathered over all documents, are all that the fit needs, however
many documents there are. The posterior labels of a bounded sample then train a
linear scorer on hashed features: words, shapes of words and the deciles of the
text's ratios. Every document is scored over its whole text.

Null and empty texts get no useful vote but for their length and score low; very
long ones are scored whole. The scorer learns from the ``SAMPLE`` ids with the
smallest hash, less those with texts over ``FIT_CHARS`` code points; rows
without an id are left out, and of repeated ids the smallest text counts.
Repeated rows count in the statistics and score alike, so ties in the score are
given out as they are. An empty table gives none. Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import least_ids, let, sample_texts, words_of
from spindrift.llm.quality_rules import STOP_WORDS

SAMPLE = 4_000
FIT_CHARS = 20_000
BITS = 18
#: Characters that mark tables, code and junk rather than prose.
SYMBOLS = r"[^#*$%&|<>=_~^{}\[\]\\]+"


def votes() -> dict[str, Column]:
    """The labellers over ``__text`` and ``__words``, each 1 (good), 0 (bad) or null (no vote)."""
    words, t = F.col("__words"), F.col("__text")
    n, chars = F.greatest(F.size(words), F.lit(1)), F.greatest(F.length(t), F.lit(1))
    stop = F.size(F.filter(words, lambda w: F.lower(w).isin(sorted(set(STOP_WORDS))))) / n
    symbol = F.length(F.regexp_replace(t, SYMBOLS, "")) / n
    upper = F.length(F.regexp_replace(t, r"\P{Lu}+", "")) / chars
    same = let(words, lambda w: F.size(F.array_distinct(w))) / n
    ends = F.length(F.regexp_replace(t, r"[^.!?]+", "")) / n
    after = let(words, lambda w: F.size(F.filter(F.transform(w, lambda x, i: F.coalesce(F.get(w, i - 1) == x, F.lit(False))), lambda b: b))) / n

    shout = F.size(F.filter(words, lambda w: w.endswith("!!"))) / n
    marked = F.size(F.filter(words, lambda w: w.rlike(r"[#*$%&|]$"))) / n
    bad = lambda c: F.when(c, 0).cast("int")
    good = lambda c: F.when(c, 1).cast("int")
    prose = (stop > 0.08) & (symbol < 0.03) & (after < 0.05)
    # one that looks for a kind of junk says nothing of texts without it
    return {
        "length": F.when(n < 4, 0).when((n >= 40) & prose, 1).cast("int"),
        "stop_words": F.when(stop < 0.04, 0).when((stop > 0.12) & prose, 1).cast("int"),
        "symbols": bad(symbol > 0.10),
        "marked": bad(marked > 0.08),
        "capitals": bad(upper > 0.25),
        "shouting": bad(shout > 0.10),
        "variety": bad((same < 0.3) & (n > 30) & (n < 2000)),
        "stutter": bad(after > 0.10),
        "sentences": F.when((ends < 0.01) & (n > 40), 0).when((ends > 0.02) & (ends < 0.4) & prose, 1).cast("int"),
        "prose": good(prose & (upper < 0.1) & (marked < 0.02) & (shout < 0.02) & (n >= 10)),
    }


def vote_table(docs: DataFrame) -> DataFrame:
    """doc_id, the text (null as empty) and one column for each labeller."""
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("__text"), words_of(F.col("text")).alias("__words"))
    return base.select("doc_id", F.col("__text").alias("text"), *[c.alias(f"lf_{k}") for k, c in votes().items()])


class LabelModel:
    """Accuracies of the labellers under the assumption that they err independently."""

    def __init__(self, patterns: np.ndarray, counts: np.ndarray, rounds: int = 50):
        """patterns: -1 (no vote), 0 or 1 for each pattern and labeller; counts: how often each occurs."""
        k = patterns.shape[1]
        self.right = np.full((2, k), 0.8)  # share of correct votes by class
        self.prior = 0.75
        if not len(patterns):
            return
        for _ in range(rounds):
            p = self.posterior(patterns)
            w = np.stack([(1 - p) * counts, p * counts])
            self.prior = float(np.clip(w[1].sum() / counts.sum(), 0.02, 0.98))
            for c in (0, 1):
                # pseudo-votes, so that no accuracy is 0 or 1; a labeller is better than chance
                hit = (w[c][:, None] * (patterns == c)).sum(0) + 8
                all_ = (w[c][:, None] * (patterns >= 0)).sum(0) + 10
                self.right[c] = np.maximum(hit / all_, 0.6)

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Probability of good for each pattern."""
        score = np.full(len(patterns), np.log(self.prior / (1 - self.prior)))
        r0, r1 = self.right
        score = score + np.where(patterns == 1, np.log(r1 / (1 - r0)), 0).sum(1) + np.where(patterns == 0, np.log((1 - r1) / r0), 0).sum(1)
        return 1 / (1 + np.exp(-score))


_WORD = re.compile(r"[^\x20\x09-\x0D]+")


_LOWER, _UPPER, _DIGIT = re.compile(r"[a-zà-öø-ÿß]+"), re.compile(r"[A-ZÀ-ÖØ-Þ]+"), re.compile(r"[0-9]+")


def _shape(w: str) -> str:
    return _DIGIT.sub("9", _UPPER.sub("A", _LOWER.sub("a", w)))[:12]


def _keys_of(w: str, known: dict[str, tuple[str, str | None]]) -> tuple[str, str | None]:
    """The keys of a word's shape and, for a stop word, of the word; ``known`` remembers those of short words."""
    low = w.lower()
    keys = "s" + _shape(w), "w" + low if low in _STOP else None
    if len(w) <= 24:
        if len(known) >= 200_000:
            known.clear()
        known[w] = keys
    return keys


def features(text: str | None, bits: int = BITS, known: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values: shares of word shapes and stop words, and one flag for each ratio's decile."""
    words = _WORD.findall(text or "")
    known = {} if known is None else known
    n = max(1, len(words))
    seen = Counter(words)
    share: dict[str, float] = {}
    stop = 0
    for w, c in seen.items():
        shape, key = known.get(w) or _keys_of(w, known)
        share[shape] = share.get(shape, 0) + c
        if key:
            share[key] = share.get(key, 0) + c
            stop += c
    again = sum(map(eq, words, words[1:]))
    flags = [f"n{min(20, int(np.log2(n)))}", f"v{int(10 * len(seen) / n)}", f"k{int(10 * min(1, stop / n))}", f"g{int(10 * again / n)}"]
    keys = [*share, *flags]
    values = [*(np.sqrt(v / n) for v in share.values()), *([1.0] * len(flags))]
    return np.array([zlib.crc32(k.encode()) >> (32 - bits) for k in keys], np.int64), np.array(values)


_STOP = set(STOP_WORDS)


def fit_scorer(texts: list[str], target: np.ndarray, bits: int = BITS, rounds: int = 300, l2: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on soft labels."""
    if not len(texts):
        return np.zeros(1 << bits, np.float32), 0.0
    rows = [features(t, bits) for t in texts]
    used, ci = np.unique(np.concatenate([r[0] for r in rows]), return_inverse=True)
    ri = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    val = np.concatenate([r[1] for r in rows])
    w, b, g2, gb2 = np.zeros(len(used)), 0.0, np.full(len(used), 1e-8), 1e-8
    n = len(rows)
    for _ in range(rounds):  # full-batch AdaGrad
        e = 1 / (1 + np.exp(-(np.bincount(ri, val * w[ci], n) + b))) - target
        g = np.bincount(ci, val * e[ri], len(used)) / n + l2 * w
        gb = e.mean()
        g2 += g * g
        gb2 += gb * gb
        w -= 0.5 * g / np.sqrt(g2)
        b -= 0.5 * gb / np.sqrt(gb2)
    out = np.zeros(1 << bits, np.float32)
    out[used] = w
    return out, float(b)


def quality_classifier(docs: DataFrame, sample: int = SAMPLE, threshold: float = 0.5, details: dict | None = None) -> DataFrame:
    """doc_id, score (probability of good) and kept of every document.

    The scorer learns from the ``sample`` documents with the smallest hash of
    doc_id. ``details``, if given, receives the label model.
    """
    table = vote_table(docs)
    names = [c for c in table.columns if c.startswith("lf_")]
    # at most 3 ** labellers rows
    patterns = table.groupBy(*names).count().collect()
    code = lambda r: [-1 if r[c] is None else r[c] for c in names]
    pats = np.array(sorted(code(r) for r in patterns), np.int64).reshape(-1, len(names))
    counts = {tuple(code(r)): r["count"] for r in patterns}
    model = LabelModel(pats, np.array([counts[tuple(p)] for p in pats.tolist()], float))
    if details is not None:
        details["model"], details["names"] = model, names
    ids = least_ids(docs.select(F.col("doc_id").cast("bigint").alias("doc_id")), sample, sum(counts.values()))
    texts = sample_texts(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), ids, FIT_CHARS)
    rows = vote_table(docs.sparkSession.createDataFrame([(r.doc_id, r.text) for r in texts], "doc_id bigint, text string")).collect()
    y = model.posterior(np.array([code(r) for r in rows], np.int64).reshape(-1, len(names))) if rows else np.zeros(0)
    weights, bias = fit_scorer([r["text"] for r in rows], y)
    shipped = docs.sparkSession.sparkContext.broadcast((weights, bias))

    def run(batches):
        w, b0 = shipped.value
        known: dict = {}
        for b in batches:
            s = []
            for t in b.column(1):
                at, v = features(t.as_py(), known=known)
                s.append(float(1 / (1 + np.exp(-(float((w[at] * v).sum()) + b0)))))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64()), pa.array([x >= threshold for x in s], pa.bool_())], names=["doc_id", "score", "kept"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, score double, kept boolean")

