"""Benchmark decontamination by q-gram lemma filtering (operator 10).

Texts are lower-cased and their white space runs become one space. An item of
m characters that occurs in a document with at most e edits shares at least
m - q + 1 - q e of its q-grams with one window of diagonals of the alignment. So
each document's q-grams are looked up among the benchmark's, hits are counted
for (item, diagonal band) with bands that overlap by half, so that any e + 1
neighbouring diagonals lie within one band, and the regions whose distinct item
q-grams reach the bound are verified by an alignment of the item against the
region, banded around those diagonals. An occurrence within the edit budget is
never missed, and nothing is reported without one.

The budget is ``RATE`` of the item's length, less where the lemma's bound would
fall under one shared q-gram. Items shorter than ``MIN_CHARS`` characters are
matched without edits and between word boundaries. The benchmark is shipped in
blocks of at most ``BLOCK_CHARS`` characters. The documents pass once: each
worker holds some of them (``HELD_CHARS``) and one block's index at a time.

A document's hits are expanded for so many items at a time that there are at
most ``HITS`` of them. Where one item and one stretch of a document have more
(both repeat a q-gram), the stretch's bands are all verified without counting,
which finds the same.

Null and empty texts are clean; null and empty items match nothing. Very long
texts are searched whole. Repeated items are all reported; repeated documents
each get a row. Of several occurrences of an item the one of fewest edits
counts, of those the first band's. Without items all is clean; an empty table
gives none. All other columns stay; ``decontaminate`` works under a name that the
table doesn't have.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import fresh

Q = 8
RATE = 0.08
MIN_CHARS = 24
BLOCK_CHARS = 4_000_000
HELD_CHARS = 32_000_000
HITS = 1_000_000
_BITS = 22
_NONE = np.uint64(2**63)  # no character
_MULT = np.uint64(0x9E3779B97F4A7C15)
_TOKEN = re.compile(r"\w+|[^\w\s]")


def normalise(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def budget(m: int, q: int = Q, rate: float = RATE) -> int:
    """Edits allowed for an item of m characters: the lemma must ask for one q-gram at least."""
    return max(0, min(int(rate * m), (m - q) // q))


def _grams(chars: np.ndarray, q: int) -> np.ndarray:
    """Hashes of all windows of q characters, each made of the hashes of its halves."""
    n = len(chars) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    if q == 1:
        return chars * _MULT
    left = _grams(chars, q // 2)
    right = left if q % 2 == 0 else _grams(chars, q - q // 2)
    h = left[:n] * _MULT
    h += right[q // 2 : q // 2 + n]
    h ^= h >> np.uint64(29)
    h *= _MULT
    return h


def _chars(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), "<u4").astype(np.uint64)


def banded_distances(items: np.ndarray, text: np.ndarray, first: np.ndarray, width: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row of items its least edits against a part of the text, and where that part ends.

    Row i of item r's alignment covers the text's positions i + first[r] to
    i + first[r] + width; these must exist, so the text is padded with what no item has.
    Parts may start and end anywhere. Gives limit + 1 where no alignment is within it.
    """
    far, k = limit + 1, np.arange(width + 1, dtype=np.int32)
    best, end = np.full(len(items), far, np.int32), np.full(len(items), -1, np.int64)
    live = np.arange(len(items))
    row = np.zeros((len(items), width + 1), np.int32)
    at = first[:, None] + k
    for i in range(1, items.shape[1] + 1):
        new = row + (text[at + (i - 1)] != items[live, i - 1][:, None])  # along the diagonal
        new[:, :-1] = np.minimum(new[:, :-1], row[:, 1:] + 1)  # the item's character is missing from the text
        new = np.minimum.accumulate(new - k, axis=1) + k  # the text has a character more
        row = np.minimum(new, far)
        if i % 8 == 0:
            on = row.min(1) < far
            if not on.all():
                live, row, at = live[on], row[on], at[on]
                if not len(live):
                    return best, end
    place = row.argmin(1)
    best[live] = row[np.arange(len(live)), place]
    end[live] = items.shape[1] + first[live] + place
    return best, end


class Index:
    """The q-grams of a block of items."""

    def __init__(self, items: list[tuple[int, str]], q: int = Q, rate: float = RATE, min_chars: int = MIN_CHARS):
        self.q = q
        plain, least = [(i, normalise(t)) for i, t in items], max(min_chars, q)
        self.items = [(i, _chars(t)) for i, t in plain if len(t) >= least]
        self.short: dict[str, list[tuple[int, int, str, str]]] = {}  # by their first token, with their last
        for n, (i, t) in enumerate(plain):
            if 0 < len(t) < least:
                tokens = _TOKEN.findall(t)
                self.short.setdefault(tokens[0], []).append((n, i, t, tokens[-1]))
        self.edits = np.array([budget(len(c), q, rate) for _, c in self.items], np.int64)
        self.size = np.array([len(c) for _, c in self.items], np.int64)
        self.need = self.size - q + 1 - q * self.edits
        grams = [_grams(c, q) for _, c in self.items]
        self.gram = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        self.of = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        self.pos = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.zeros(0, np.int64)
        o = np.argsort(self.gram, kind="stable")
        self.gram, self.of, self.pos = self.gram[o], self.of[o], self.pos[o]
        self.order = None
        self.keys, start = np.unique(self.gram, return_index=True)
        self.start, self.stop = start, np.append(start[1:], len(self.gram))
        self.longest = int((self.size + self.edits).max()) if len(self.items) else 0
        self.pad = 4 * self.longest + 8
        self.filter = np.zeros(1 << _BITS, bool)
        self.filter[(self.keys >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def find(self, text: str | None) -> list[tuple[int, int, int]]:
        """(item id, end in the normalised text, edits) of each item that the text holds, the best occurrence."""
        t = normalise(text)
        return sorted(self._find_short(t) + self._find_long(t))

    def _find_short(self, t: str) -> list[tuple[int, int, int]]:
        if not self.short:
            return []
        found: dict[int, tuple[int, int, int]] = {}
        for m in _TOKEN.finditer(t):
            for n, i, item, last in self.short.get(m.group(), ()):
                end = m.start() + len(item)
                if n not in found and t.startswith(item, m.start()) and _TOKEN.match(last[-1:] + t[end : end + 1]).end() == 1:
                    found[n] = (i, end, 0)
        return [*found.values()]

    def _find_long(self, t: str) -> list[tuple[int, int, int]]:
        if len(t) < self.q or not len(self.keys):
            return []
        chars = _chars(t)
        g = _grams(chars, self.q)
        at = np.flatnonzero(self.filter[(g >> np.uint64(64 - _BITS)).astype(np.int64)])
        if not len(at):
            return []
        k = np.minimum(np.searchsorted(self.keys, g[at]), len(self.keys) - 1)
        real = self.keys[k] == g[at]
        at, k = at[real], k[real]
        if len(at) < (self.need.min() if len(self.need) else 1):
            return []
        found: dict[int, tuple[int, int]] = {}
        text = np.concatenate([np.full(self.pad, _NONE), chars, np.full(self.pad, _NONE)])
        self._search(text, at, k, 0, len(self.items), found)
        return [(self.items[i][0], end, d) for i, (end, d) in found.items()]

    def _postings(self, k: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """First and last + 1 of each q-gram's postings in items lo to hi - 1."""
        if lo == 0 and hi == len(self.items):
            return self.start[k], self.stop[k]
        if self.order is None:
            self.order = np.repeat(np.arange(len(self.keys)), self.stop - self.start) * len(self.items) + self.of
        return np.searchsorted(self.order, k * len(self.items) + lo), np.searchsorted(self.order, k * len(self.items) + hi)

    def _search(self, text: np.ndarray, at: np.ndarray, k: np.ndarray, lo: int, hi: int, found: dict) -> None:
        """The items lo to hi - 1 that the padded text holds, by the q-grams k at the places ``at``; halves what is too much at once."""
        if not len(at):
            return
        first, last = self._postings(k, lo, hi)
        n = last - first
        total = int(n.sum())
        if total < self.need[lo:hi].min():
            return
        if total <= HITS:
            post = np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(total)
            self._verify(text, self.of[post], self.pos[post], np.repeat(at, n), found)
        elif hi - lo > 1:
            mid = (lo + hi) // 2
            some = n > 0
            self._search(text, at[some], k[some], lo, mid, found)
            self._search(text, at[some], k[some], mid, hi, found)
        elif (wide := int(at[-1] - at[0]) // 2) > 2 * self.longest:
            # an occurrence lies in one of two stretches that overlap by its most length
            cut = int(at[0]) + wide
            left, right = at < cut + self.longest, at >= cut
            self._search(text, at[left], k[left], lo, hi, found)
            self._search(text, at[right], k[right], lo, hi, found)
        else:
            step = int(self.edits[lo]) + 1
            bands = np.arange(int(at[0]) // step - 1, (int(at[-1]) + int(self.size[lo])) // step + 1)
            self._align(text, np.full(len(bands), lo), bands, found)

    def _verify(self, text: np.ndarray, item: np.ndarray, pos: np.ndarray, here: np.ndarray, found: dict) -> None:
        # items that can't reach the bound anywhere go first
        keep = (np.bincount(item, minlength=len(self.items)) >= self.need)[item]
        if not keep.any():
            return
        item, pos, here = item[keep], pos[keep], here[keep]
        band = (here - pos + self.size[item]) // (self.edits[item] + 1)  # not negative
        # band b covers the diagonals of steps b and b + 1, so each hit lies in two
        key = np.stack([np.tile(item, 2), np.concatenate([band, band - 1]), np.tile(pos, 2)], 1)
        key = key[np.lexsort((key[:, 2], key[:, 1], key[:, 0]))]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]).any(1)
        key = key[new]  # each q-gram of the item counts once for a band
        edge = np.ones(len(key), bool)
        edge[1:] = (key[1:, :2] != key[:-1, :2]).any(1)
        first = np.flatnonzero(edge)
        count = np.diff(np.append(first, len(key)))
        enough = key[first[count >= self.need[key[first, 0]]]]
        self._align(text, enough[:, 0], enough[:, 1], found)

    def _align(self, text: np.ndarray, item: np.ndarray, band: np.ndarray, found: dict) -> None:
        """Verify bands of items, those of one length together; the padded text's first character is at ``self.pad``."""
        for m in np.unique(self.size[item]):
            some = self.size[item] == m
            i, e = item[some], int(self.edits[item[some][0]])
            # the band's diagonals: low to low + 2 e + 1; alignments stray by e more
            first, width = band[some] * (e + 1) - m - e, 4 * e + 1
            step = max(1, 400_000 // (width + int(m)))
            for at in range(0, len(i), step):
                own, start = i[at : at + step], first[at : at + step]
                d, end = banded_distances(np.stack([self.items[x][1] for x in own]), text, start + self.pad, width, e)
                for x, dist, stop in zip(own.tolist(), d.tolist(), end.tolist()):
                    if dist <= e and (x not in found or dist < found[x][1]):
                        found[x] = (stop - self.pad, dist)


class Block:
    """Items as they are shipped; a worker that keeps the broadcast keeps the index."""

    def __init__(self, items: list[tuple[int, str]], q: int, rate: float):
        self.items, self.q, self.rate, self._index = items, q, rate, None

    def index(self, keep: bool) -> Index:
        if self._index is not None:
            return self._index
        made = Index(self.items, self.q, self.rate)
        if keep:
            self._index = made
        return made


def _blocks(benchmark: DataFrame, block_chars: int):
    """The items in blocks of bounded size, one block on the driver at a time."""
    block, size = [], 0
    items = benchmark.filter(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", "text").orderBy("item_id", "text")
    for r in items.toLocalIterator():
        if block and size + len(r.text) > block_chars:
            yield block
            block, size = [], 0
        block.append((int(r.item_id), r.text))
        size += len(r.text)
    yield block


_HITS = "array<struct<item_id bigint, end_char bigint, edits int>>"


def contamination(docs: DataFrame, benchmark: DataFrame, q: int = Q, rate: float = RATE, block_chars: int = BLOCK_CHARS, name: str = "hits") -> DataFrame:
    """The documents with ``name``, the items each holds (end_char in its normalised text), in place of a column of that name."""
    docs = docs.drop(name)
    blocks = [docs.sparkSession.sparkContext.broadcast(Block(b, q, rate)) for b in _blocks(benchmark, block_chars)]
    hit_type = pa.list_(pa.struct([("item_id", pa.int64()), ("end_char", pa.int64()), ("edits", pa.int32())]))

    def hits(texts: list) -> list:
        out: list[list] = [[] for _ in texts]
        for shipped in blocks:
            index = shipped.value.index(keep=len(blocks) == 1)
            for own, t in zip(out, texts):
                own += index.find(t)
        return [[{"item_id": i, "end_char": e, "edits": d} for i, e, d in own] for own in out]

    def run(batches):
        def found(held):
            new = iter(hits([t for _, texts in held for t in texts]))
            for b, texts in held:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([next(new) for _ in texts], hit_type)], names=[*b.schema.names, name])

        held, size = [], 0
        for b in batches:
            texts = b.column(b.schema.get_field_index("text")).to_pylist()
            held.append((b, texts))
            size += sum(len(t or "") for t in texts)
            if len(blocks) == 1 or size >= HELD_CHARS:  # with one block there is nothing to wait for
                yield from found(held)
                held, size = [], 0
        yield from found(held)

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema)
    return docs.mapInArrow(run, f"{fields}`{name}` {_HITS}")


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that hold no item; all columns stay."""
    name = fresh("hits", docs)
    return contamination(docs, benchmark, name=name, **options).filter(F.size(name) == 0).select(*docs.columns)
