"""BM25 over an inverted index: k1 1.2, b 0.75, all columns of equal weight."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.functions.text import col, fold, let, tokens

K1, B = 1.2, 0.75
COLUMNS = ("name", "scope", "relative_path", "content")


def _words(columns) -> Column:
    return F.flatten(F.array(*[tokens(fold(F.coalesce(F.col(c), F.lit("")))) for c in columns]))


def _counted(words: Column) -> Column:
    """(term, tf) of each distinct word of an array: sorted, then the lengths of the runs."""
    last = lambda x: F.filter(F.transform(x, lambda v, i: F.struct(v.alias("term"), i.alias("i"), F.coalesce(F.get(x, i + 1) != v, F.lit(True)).alias("end"))), lambda e: e["end"])
    runs = lambda e: F.transform(e, lambda v, i: F.struct(v["term"].alias("term"), (v["i"] - F.coalesce(F.get(e, i - 1)["i"], F.lit(-1))).cast("bigint").alias("tf")))
    return let(F.sort_array(words), lambda x: let(last(x), runs))


def postings(units: DataFrame, columns=COLUMNS, keys: tuple[str, ...] = ("unit_ix",)) -> DataFrame:
    """term, unit_ix (or other keys), tf over the indexed columns; the units' keys are unique, so a row counts its own words and nothing is shuffled."""
    return units.select(*keys, F.inline(_counted(_words(columns)))).select("term", *keys, "tf")


def doc_stats(units: DataFrame, columns=COLUMNS, keys: tuple[str, ...] = ("unit_ix",)) -> DataFrame:
    """unit_ix, len: the number of indexed tokens; no shuffle."""
    total = F.lit(0)
    for c in columns:
        total = total + F.size(tokens(fold(F.coalesce(F.col(c), F.lit("")))))
    return units.select(*keys, total.cast("bigint").alias("len"))


def query_terms(query: str) -> dict[str, int]:
    """The terms of a query and how often each is asked for (a repeated one counts again)."""
    import re
    import unicodedata

    out: dict[str, int] = {}
    for t in re.findall(r"\w+", query):
        if len(t.encode()) >= 2:
            low = "".join(c for c in unicodedata.normalize("NFD", t.lower()) if not unicodedata.combining(c))
            out[low] = out.get(low, 0) + 1
    return out


def bm25(units: DataFrame, query: str, limit: int, columns=COLUMNS) -> DataFrame:
    """unit_ix, score of the best units; N and the average length are those of all units.

    Two scans without a shuffle: one counts the units, their words and those that have each asked term, which is one
    row; the other scores each unit by itself and keeps a bounded heap in every task.
    """
    terms = query_terms(query)
    none = units.select("unit_ix", F.lit(0.0).alias("score")).limit(0)
    if not terms:
        return none
    asked = let(_words(columns), lambda w: F.struct(F.size(w).cast("bigint").alias("len"), _counted(F.filter(w, lambda x: x.isin(list(terms)))).alias("asked")))
    whole = units.select("unit_ix", asked.alias("w"))
    has = [F.count_if(F.array_contains("w.asked.term", t)).alias(f"n{i}") for i, t in enumerate(terms)]
    row = whole.agg(F.count(F.lit(1)).alias("units"), F.avg("w.len").alias("avg_len"), *has).first()
    df = {t: n for i, t in enumerate(terms) if (n := row[f"n{i}"])}
    if not df:
        return none
    part = _part(terms, df, (row.units, row.avg_len))
    score = F.aggregate("w.asked", F.lit(0.0), lambda a, x: a + part(x["term"], x["tf"], F.col("w.len")))
    return whole.filter(F.size("w.asked") > 0).select("unit_ix", score.alias("score")).orderBy(F.desc("score"), "unit_ix").limit(limit)


def _part(terms: dict[str, int], df: dict[str, int], total: tuple[int, float]):
    """A term's part of a unit's score, of the term, how often it stands there and the unit's length."""

    def part(term: Column, tf: Column, length: Column) -> Column:
        weight = F.lit(0.0)
        for t, n in df.items():
            idf = math.log((total[0] - n + 0.5) / (n + 0.5))
            weight = F.when(term == t, terms[t] * (idf if idf > 0 else 1e-6)).otherwise(weight)
        return weight * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.lit(float(total[1]))))

    return part


def bm25_index(postings_: DataFrame, stats: DataFrame, query: str, limit: int, key: str = "unit_ix", total: tuple[int, float] | None = None) -> DataFrame:
    """The same from an index: only the query's postings are read, and the lengths of the units that they name.

    ``total``: the number of units and their average length, where they're stored.
    """
    terms = query_terms(query)
    if not terms:
        return stats.select(key, F.lit(0.0).alias("score")).limit(0)
    found = postings_.filter(F.col("term").isin(list(terms)))
    # as many rows as the query has terms
    df = {r.term: r.n for r in found.groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect()}
    if total is None:
        row = stats.agg(F.count(F.lit(1)).alias("units"), F.avg("len").alias("avg_len")).first()
        total = row.units, row.avg_len
    if not df or not total[0]:
        return stats.select(key, F.lit(0.0).alias("score")).limit(0)
    part = _part(terms, df, total)(F.col("term"), F.col("tf"), F.col("len"))
    return found.join(stats.select(key, "len"), key).groupBy(key).agg(F.sum(part).alias("score")).orderBy(F.desc("score"), key).limit(limit)


class StoredIndex:
    """Postings sorted by term, with filters that let a reader skip files without it, and the units' lengths.

    Made by ``build`` and complete once its last file, the totals, is there; a call before that scans the units, for
    one query is answered by far less work than an index takes.
    """

    def __init__(self, spark, folder: str, units: Callable[[], DataFrame], columns=COLUMNS):
        self.spark, self.folder, self.units, self.columns = spark, folder, units, columns

    def _there(self) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/totals/_SUCCESS")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def build(self) -> None:
        units = self.units()
        ordered = postings(units, self.columns).repartitionByRange("term").sortWithinPartitions("term")
        ordered.write.mode("overwrite").option("parquet.bloom.filter.enabled#term", "true").parquet(f"{self.folder}/postings")
        doc_stats(units, self.columns).write.mode("overwrite").parquet(f"{self.folder}/lengths")
        lengths = self.spark.read.parquet(f"{self.folder}/lengths")
        lengths.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("len"), F.lit(0.0)).alias("average")).write.mode("overwrite").parquet(f"{self.folder}/totals")

    def __call__(self, query: str, limit: int) -> DataFrame:
        if not self._there():
            return bm25(self.units(), query, limit, self.columns)
        read = lambda name, schema: self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")
        n, average = read("totals", "n bigint, average double").first()
        return bm25_index(read("postings", "term string, unit_ix bigint, tf bigint"), read("lengths", "unit_ix bigint, len bigint"), query, limit, total=(n, average))


def lexical_list(units: DataFrame, query: str, take: int, condition=None, index=None) -> DataFrame:
    """Ranked unit_ix: twice as many are fetched first, the filter comes after that limit.

    ``index``: a function of (query, limit) that ranks from a stored index.
    """
    hits = index(query, 2 * take) if index is not None else bm25(units, query, 2 * take)
    kept = hits.join(units, "unit_ix")
    if condition is not None:
        kept = kept.filter(condition)
    return kept.select("unit_ix", "score").orderBy(F.desc("score"), "unit_ix").limit(take)
