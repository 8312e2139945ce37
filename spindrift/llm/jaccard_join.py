"""N-gram Jaccard join (operator 3), in DataFrame functions only.

Documents are sets of 5-word shingles; two link when their Jaccard similarity is
at least ``THRESHOLD`` percent. A set of n shingles then shares all but
``window_size(n)`` - 1 of its shingles with any set that it links to.

Isolation. Most sets link to nothing, and a set with ``window_size(n)`` shingles
that no other set has can't. So the shingles in the lowest part of the hash
space (``FIRST``) are looked up first, and the sets that are shown to be alone
leave; those left are looked up with all their shingles, and again those alone
leave. A hot shingle is combined before its shuffle, and the join that tells
the sets of their shared shingles can be split by the engine at run time.

Regions. The shingles of the sets left stand in one order, rarest first (how
many of those sets have them, then hash). A set is replicated to the regions of
the first ``window_size(n)`` of its shingles, less those it has alone; linked
sets meet in at least one region. A region of more than ``BLOCK`` sets is cut
into blocks, and each pair of blocks is a region of its own, so no task meets
more than two blocks at a time and no pair is lost. (README: why documents don't
serve as pivots, with figures.)

Pairs. The regions that a pair shares are counted, which with the sizes bounds
the overlap from above; the pairs that can still reach the threshold are
verified on all their shared shingles. Documents with equal sets are one class
with one representative (equal 64-bit hash of the sorted set and its size, so
of m different sets some two are taken for equal with a chance of m^2 / 2^65),
and links between classes count for all their members. Components spread by
minimum labels with pointer jumping.

Null and empty texts, or texts without words, have no shingles and link with
nothing. Very long texts are one set like others. Rows that repeat a document
are copies of each other. Ties can't arise: each link is decided alone, and a
component's id is its smallest doc_id. A null doc_id sorts first. An empty table
gives none. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import NULL_ID, ascii_lower, checkpointed, let, words_of

WIDTH = 5
THRESHOLD = 80
#: Share of the hash space whose shingles are looked up first.
FIRST = 0.3
#: Sets that meet in one region at a time.
BLOCK = 256
#: Ids or classes up to this many are broadcast (16 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def shingles(text: Column, width: int = WIDTH) -> Column:
    """The sorted distinct 64-bit hashes of a text's shingles."""

    def hashes(w: Column) -> Column:
        many = F.transform(F.sequence(F.lit(1), F.size(w) - (width - 1)), lambda i: F.xxhash64(F.slice(w, i, width)))
        return F.when(F.size(w) >= width, many).when(F.size(w) > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))

    return F.sort_array(F.array_distinct(let(words_of(ascii_lower(F.coalesce(text, F.lit("")))), hashes)))


def window_size(n: Column, threshold: int = THRESHOLD) -> Column:
    """A set of n shingles that misses so many of another's can't link to it."""
    return n - F.ceil(n * threshold / 100) + 1


def _small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marked for a broadcast if it's counted to be small."""
    return F.broadcast(df) if df.count() <= rows else df


def sets_of(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n, hs (the set) and k (its class; null for an empty set)."""
    base = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NULL_ID)).alias("doc_id"), shingles(F.col("text"), width).alias("hs"))
    n = F.size("hs")
    return base.select("doc_id", n.alias("n"), "hs", F.when(n > 0, F.xxhash64(F.col("hs"), n)).alias("k"))


def shared_rows(rows: DataFrame) -> DataFrame:
    """The rows whose shingle h more than one row has, with df, how many.

    Rows of a document that is there twice may make a shingle look shared; that
    only keeps a class longer among the candidates.
    """
    met = rows.groupBy("h").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    return rows.join(met.hint("shuffle_hash"), "h")


def not_alone(low: DataFrame, classes: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """The classes that the lowest shingles don't show to be alone. low: doc_id, k and hs; classes: k, rep, n, members and seen (lowest shingles)."""
    several = classes.filter("members > 1").select("k", "rep")
    one = low.join(_small(several), "k", "left").filter("rep IS NULL OR rep = doc_id")
    shared = shared_rows(one.select("k", F.explode("hs").alias("h"))).groupBy("k").agg(F.count(F.lit(1)).alias("c"))
    left = classes.join(shared, "k", "left")
    alone = F.col("seen") - F.coalesce("c", F.lit(0))
    return left.filter(alone < window_size(F.col("n"), threshold)).select("k", "rep", "n")


def shared_sets(docs: DataFrame, left: DataFrame, threshold: int = THRESHOLD, width: int = WIDTH) -> DataFrame:
    """k, n and hs (shingles shared with other classes, rarest first) of the classes left that aren't alone.

    A shingle is the logarithm of its df above 57 bits of its hash, so a sorted
    set is in the order of the windows.
    """
    ids = _small(left.select(F.col("rep").alias("doc_id")).distinct())
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NULL_ID)).alias("doc_id"), "text")
    some = sets_of(keyed.join(ids, "doc_id", "left_semi"), width)
    # a repeated id may bring other texts
    sets = checkpointed(some.join(_small(left.select("k")), "k", "left_semi").select("k", "n", "hs"))
    rows = sets.select("k", "n", F.explode("hs").alias("h"))
    code = F.shiftleft(F.floor(F.log2("df")), 57).bitwiseOR(F.col("h").bitwiseAND((1 << 57) - 1))
    own = shared_rows(rows).groupBy("k", "n").agg(F.sort_array(F.collect_set(code)).alias("hs"))
    return own.filter(F.col("n") - F.size("hs") < window_size(F.col("n"), threshold))


def region_pairs(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """a < b, na, nb: each two sets as often as they meet in a region. rows: h, k, n."""
    sizes = rows.groupBy("h").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    cut = rows.join(sizes, "h").withColumn("blocks", F.ceil(F.col("m") / block).cast("int"))
    cut = cut.withColumn("x", F.pmod(F.xxhash64("k"), F.col("blocks")).cast("int")).withColumn("y", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cut = cut.select("h", "k", "n", "x", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"))
    a, b = (cut.select("h", "i", "j", F.col("k").alias(c), F.col("n").alias(f"n{c}"), F.col("x").alias(f"x{c}")) for c in "ab")
    # two of one block meet where the block meets itself
    return a.join(b, ["h", "i", "j"]).filter("a < b AND (i = j OR xa <> xb)").select("a", "b", "na", "nb")


def similar_pairs(docs: DataFrame, left: DataFrame, threshold: int = THRESHOLD, width: int = WIDTH, block: int = BLOCK) -> DataFrame:
    """a < b: the classes whose sets link."""
    sets = checkpointed(shared_sets(docs, left, threshold, width))
    p = window_size(F.col("n"), threshold)
    first = F.slice("hs", F.lit(1), F.greatest(p - (F.col("own")), F.lit(0)).cast("int"))
    rows = checkpointed(sets.withColumn("own", F.col("n") - F.size("hs")).select("k", "n", F.explode(first).alias("h")))
    met = region_pairs(rows, block).filter(F.lit(100) * F.least("na", "nb") >= threshold * F.greatest("na", "nb"))
    met = met.groupBy("a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("c"))
    # overlap of sets with that similarity; and the most that can lie behind the windows
    need = F.ceil(F.lit(threshold) * (F.col("na") + F.col("nb")) / (100 + threshold))
    behind = lambda n: n - window_size(n, threshold)
    near = met.filter(F.col("c") + F.greatest(behind(F.col("na")), behind(F.col("nb"))) >= need)
    one, other = (sets.select(F.col("k").alias(c), F.col("hs").alias(f"h{c}")) for c in "ab")
    full = near.select("a", "b", (F.col("na") + F.col("nb")).alias("s")).join(one, "a").join(other, "b").withColumn("o", F.size(F.array_intersect("ha", "hb")))
    return full.filter(F.lit(100) * F.col("o") >= threshold * (F.col("s") - F.col("o"))).select("a", "b")


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """k, label: the smallest ``start`` of each node's component. nodes: k, start; edges: a, b."""
    both = checkpointed(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = checkpointed(nodes.select("k", F.col("start").alias("label"), F.col("start")))
    while True:
        near = both.join(labels.select(F.col("k").alias("b"), F.col("label").alias("l")), "b").groupBy("a").agg(F.min("l").alias("l"))
        lower = labels.join(near.withColumnRenamed("a", "k"), "k", "left").select("k", "start", "label", F.least("label", F.coalesce("l", "label")).alias("new"))
        # jump: the label of the node whose start is this label
        to = lower.groupBy(F.col("start").alias("new")).agg(F.min("new").alias("further"))
        moved = lower.join(to, "new", "left").select("k", "start", "label", F.least("new", F.coalesce("further", "new")).alias("new"))
        moved = checkpointed(moved)
        changed = moved.filter(F.col("new") < F.col("label")).limit(1).count()
        labels = moved.select("k", F.col("new").alias("label"), "start")
        if not changed:
            return labels.select("k", "label")


def jaccard_join(docs: DataFrame, threshold: int = THRESHOLD, width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles, n_similar and component_id of every row."""
    docs = docs.select("doc_id", "text")
    low = F.lit(-(2**63) + int(FIRST * 2**64))
    slim = checkpointed(sets_of(docs, width).select("doc_id", "n", "k", F.filter("hs", lambda x: x < low).alias("hs")))
    told = F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("members"), F.min("n").alias("n"), F.min(F.size("hs")).alias("seen")
    classes = checkpointed(slim.filter("k IS NOT NULL").groupBy("k").agg(*told))
    left = checkpointed(not_alone(slim.filter("k IS NOT NULL").select("doc_id", "k", "hs"), classes, threshold))
    edges = checkpointed(similar_pairs(docs, left, threshold, width))
    linked = edges.select(F.col("a").alias("k")).union(edges.select(F.col("b").alias("k"))).distinct()
    nodes = checkpointed(classes.join(linked, "k", "left_semi"))
    labels = components(edges, nodes.select("k", F.col("rep").alias("start")))
    both = edges.union(edges.select("b", "a"))
    others = both.join(nodes.select(F.col("k").alias("b"), "members"), "b").groupBy(F.col("a").alias("k")).agg(F.sum("members").alias("others"))
    # only classes of several members or with links say more than the document itself
    told = classes.join(others, "k", "left").join(labels, "k", "left").filter("members > 1 OR label IS NOT NULL")
    told = checkpointed(told.select("k", (F.col("members") - 1 + F.coalesce("others", F.lit(0))).alias("similar"), F.coalesce("label", "rep").alias("component")))
    out = slim.join(_small(told), "k", "left")
    real = lambda c: F.when(c != NULL_ID, c)
    return out.select(
        real(F.col("doc_id")).alias("doc_id"), F.col("n").cast("bigint").alias("n_shingles"), F.coalesce("similar", F.lit(0)).cast("bigint").alias("n_similar"),
        real(F.coalesce("component", "doc_id")).alias("component_id"),
    )


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (
  SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(generate_series(1, len(ws) - 4), lambda i: array_to_string(ws[i:i+4], ' ')) END) AS g FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT a, b FROM met JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, (SELECT count(*) FROM e WHERE e.a = w.doc_id)::BIGINT AS n_similar,
       (SELECT min(b) FROM reach r WHERE r.a = w.doc_id)::BIGINT AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id
"""
