"""Language identification by partial matching (operator 4).

Each language has a byte context tree up to order ``ORDER``: the counts of the
bytes that followed each context in its training text. A byte's probability in
a context is c / (n + d) if the context has seen it (n bytes, d distinct ones),
otherwise the escape probability d / (n + d) times the probability in the next
shorter context; order -1 is uniform over 256. The statistics are frozen after
training, so a byte's code length depends on its context alone, and a text's
code length is a sum of table look-ups: exact, over the whole text, for all
languages at once. The shortest code wins.

Contexts that any language has seen ``MIN_CONTEXT`` times or more form the
union of the trees; a byte's state is the longest such context that ends before
it. Training takes the ``PER_LANGUAGE`` documents of each language with the
smallest hash of doc_id (not held out, text and lang not null; fewer where there
are so many languages that the sample would pass ``SAMPLE`` documents), less
those over ``FIT_CHARS`` code points; of repeated ids the smallest text counts.

Texts that are null, empty or without any letter (Unicode category L) are
``und`` with score 0. Very long texts are scored whole, in blocks. Ties go to
the language that sorts first. Repeated rows are scored alike. Without any
training text every result is ``und``; an empty table gives none. Other columns
are ignored by ``language_id`` and stay in ``identify``, which takes none that
are called lang_pred or score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindrift.llm.common import sample_texts
from spindrift.llm.toxicity import held_out

ORDER = 3
PER_LANGUAGE = 300
SAMPLE = 12_000
FIT_CHARS = 20_000
MIN_CONTEXT = 24
#: Bytes scored at a time.
BLOCK = 1 << 20


class ContextTrees:
    """Code lengths in bits for each (state, byte, language)."""

    def __init__(self, langs: list[str], symbols: np.ndarray, n_symbols: int, state_of: np.ndarray, bits: np.ndarray):
        self.langs, self.symbols, self.n_symbols, self.state_of, self.bits = langs, symbols, n_symbols, state_of, bits

    def code_lengths(self, text: str) -> np.ndarray:
        """Bits of the whole text under each language."""
        b = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
        total = np.zeros(len(self.langs))
        a, n = self.n_symbols, len(b)
        for at in range(0, n, BLOCK):
            lo = max(0, at - ORDER)
            s = self.symbols[b[lo : at + BLOCK]].astype(np.int32)
            lead = ORDER - (at - lo)
            s = np.concatenate([np.zeros(lead, np.int32), s]) if lead else s  # 0: before the text
            k = len(s) - ORDER
            key = np.zeros(k, np.int32)
            for j in range(ORDER):
                key = key * a + s[j : j + k]
            row = self.state_of[key] * a + s[ORDER:]
            total += self.bits[row].sum(0, dtype=np.float64)
        return total


def train(texts: dict[str, list[str]], order: int = ORDER, min_context: int = MIN_CONTEXT) -> ContextTrees:
    """Context trees of texts by language."""
    assert order == ORDER
    langs = sorted(texts)
    raw = {g: [np.frombuffer(t.encode("utf-8", "replace"), np.uint8) for t in texts[g]] for g in langs}
    seen = np.zeros(256, bool)
    for arrays in raw.values():
        for b in arrays:
            seen[b] = True
    # symbol 0: before the text; 1: bytes no language has seen; then the seen ones
    symbols = np.ones(256, np.uint8)
    symbols[seen] = np.arange(2, 2 + seen.sum()) if seen.sum() < 254 else np.minimum(np.arange(2, 2 + seen.sum()), 255)
    a = int(symbols.max()) + 1
    hist = {}
    for g in langs:
        parts = [np.zeros(0, np.int64)]
        for b in raw[g]:
            s = np.concatenate([np.zeros(order, np.int64), symbols[b].astype(np.int64)])
            k = len(s) - order
            key = np.zeros(k, np.int64)
            for j in range(order + 1):
                key = key * a + s[j : j + k]
            parts.append(key)
        hist[g] = np.unique(np.concatenate(parts), return_counts=True)
    # union of the contexts of each order, by how often any language has seen them
    states: list[tuple[int, int]] = [(0, 0)]
    state_of = np.zeros(a**order, np.int32)
    for o in range(1, order + 1):
        size = a**o
        often = np.zeros(size, bool)
        for keys, counts in hist.values():
            c = np.bincount((keys // a) % size, counts, size)
            often |= c >= min_context
        ids = np.zeros(size, np.int32)
        found = np.flatnonzero(often)
        ids[found] = np.arange(len(states), len(states) + len(found))
        states += [(o, int(c)) for c in found]
        tail = np.arange(a**order, dtype=np.int64) % size
        state_of = np.where(ids[tail] > 0, ids[tail], state_of).astype(np.int32)
    bits = np.zeros((len(states) * a, len(langs)), np.float32)
    orders, ctx = np.array([o for o, _ in states]), np.array([c for _, c in states])
    for gi, g in enumerate(langs):
        keys, counts = hist[g]
        p = np.full((1, a), 1 / 256)  # order -1
        shorter = None
        for o in range(order + 1):
            size = a**o
            rows = np.flatnonzero(orders == o)
            pick = np.full(size, -1, np.int64)
            pick[ctx[rows]] = np.arange(len(rows))
            where = pick[(keys // a) % size]
            inside = where >= 0
            c = np.bincount(where[inside] * a + keys[inside] % a, counts[inside], len(rows) * a).reshape(len(rows), a)
            n, d = c.sum(1, keepdims=True), (c > 0).sum(1, keepdims=True)
            if shorter is None:
                back = np.repeat(p, len(rows), 0)
            else:
                back = shorter(ctx[rows])
            with np.errstate(divide="ignore", invalid="ignore"):
                q = np.where(c > 0, c / (n + d), np.where(n + d > 0, d / np.maximum(n + d, 1), 1.0) * back)
            bits.reshape(len(states), a, len(langs))[rows, :, gi] = -np.log2(q)

            def shorter(longer, q=q, pick=pick, size=size, back_to=shorter):
                # the probabilities in the next shorter context that is a state
                at = pick[longer % size]
                if back_to is None:
                    return q[np.zeros(len(longer), np.int64)]
                return np.where((at >= 0)[:, None], q[np.maximum(at, 0)], back_to(longer))

    return ContextTrees(langs, symbols, a, state_of, bits)


def training_sample(docs: DataFrame, per_language: int = PER_LANGUAGE) -> dict[str, list[str]]:
    """The bounded sample by language, the same for any partitioning."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), 3, 1))
    per_language = max(1, min(per_language, SAMPLE // max(1, known.agg(F.count_distinct("lang")).first()[0])))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    # so small a rank is found within the map tasks first, so no language meets in one
    picked = known.select("doc_id", "lang").withColumn("k", F.row_number().over(order)).filter(F.col("k") <= per_language).select("doc_id", "lang").distinct()
    out: dict[str, list[str]] = {}
    for r in sample_texts(docs, picked, FIT_CHARS, "lang"):
        out.setdefault(r.lang, []).append(r.text)
    return out


def predict(text: str | None, model: ContextTrees) -> tuple[str, float]:
    """(language, score): the score is the posterior under equal priors, at a tenth of the code length's weight."""
    if text is None or not model.langs or not any(map(str.isalpha, text)):
        return "und", 0.0
    bits = model.code_lengths(text)
    k = int(bits.argmin())
    w = np.exp2(-(bits - bits[k]) / 10)
    return model.langs[k], float(1 / w.sum())


def identify(docs: DataFrame, model: ContextTrees) -> DataFrame:
    """The documents with lang_pred and score; only their text is looked at."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    if {"lang_pred", "score"} & set(docs.columns):
        raise ValueError("the table has a column lang_pred or score")
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema)

    def run(batches):
        m = shipped.value
        for b in batches:
            found = [predict(t.as_py(), m) for t in b.column(b.schema.get_field_index("text"))]
            cols = list(b.columns) + [pa.array([g for g, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names + ["lang_pred", "score"])

    return docs.mapInArrow(run, f"{fields}lang_pred string, score double")


def language_id(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    samples = training_sample(docs, per_language)
    model = train(samples) if samples else ContextTrees([], np.zeros(256, np.uint8), 1, np.zeros(1, np.int32), np.zeros((1, 0), np.float32))
    marked = docs.select("doc_id", "text", held_out(F.col("doc_id"), 3, 1).alias("held_out"))
    return identify(marked, model).select("doc_id", "held_out", "lang_pred", "score")
