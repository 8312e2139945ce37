"""Quality rules (operator 8): a threshold table compiled into one projection.

Every measure is a built-in expression over the whole text, so the plan is a
scan and one projection without shuffle or Python. Null and empty texts have no
words and fail the base rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import WS, let, words_of

STOP_WORDS = (
    "the of and to in is that for it with as was on be at by this from "
    "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine "
    "de la le et les des en un une que est dans qui par pour sur au avec "
    "el y los del se las por con una su para es al no"
).split()

#: (measure, least, most), None for no bound; a text is kept if every measure is within its bounds.
RULES: list[tuple[str, float | None, float | None]] = [
    ("n_words", 10, None),
    ("mean_word_chars", 1.5, 20.0),
    ("symbol_ratio", None, 0.10),  # symbols a word
    ("stop_ratio", 0.02, None),  # stop words a word
    ("dup_line_ratio", None, 0.30),  # repeated lines a line
    ("repeat_ratio", None, 0.20),  # words in repeated windows a word
    ("upper_ratio", None, 0.30),  # capital letters a character of words
]


def repeated_words(words: Column, width: int = 5) -> Column:
    """Words that lie in a window of ``width`` words found twice or more."""

    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def positions(s: Column) -> Column:
            same = lambda j, e: F.coalesce(F.get(s, j)["h"] == e["h"], F.lit(False))
            marked = F.transform(s, lambda e, j: F.when(same(j - 1, e) | same(j + 1, e), e["i"]))
            return F.sort_array(F.filter(marked, lambda x: x.isNotNull()))

        start = F.struct(F.lit(0).alias("n"), F.lit(-width).alias("at"))
        step = lambda a, p: F.struct((a["n"] + F.least(F.lit(width), p - a["at"])).alias("n"), p.alias("at"))
        return F.aggregate(let(pairs, positions), start, step)["n"]

    windows = F.transform(F.sequence(F.lit(1), F.size(words) - (width - 1)), lambda i: F.xxhash64(F.slice(words, i, width)))
    found = let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))
    return F.when(F.size(words) < width, F.lit(0)).otherwise(found)


def measures(text: Column) -> dict[str, Column]:
    """The measures of a text by name, each a column over ``__words`` and ``__lines``."""
    text = F.coalesce(text, F.lit(""))
    words, lines = F.col("__words"), F.col("__lines")
    stop = sorted(set(STOP_WORDS))
    return {
        "n_words": F.size(words).cast("bigint"),
        "word_chars": F.length(F.array_join(words, "")).cast("bigint"),
        "n_symbols": F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("bigint"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint"),
        "n_repeat_words": let(words, lambda w: repeated_words(w)).cast("bigint"),
        "n_lines": F.size(lines).cast("bigint"),
        "n_stop": F.size(F.filter(words, lambda w: F.lower(w).isin(stop))).cast("bigint"),
        "n_upper": F.length(F.regexp_replace(text, r"\P{Lu}+", "")).cast("bigint"),
    }


def quality_rules(docs: DataFrame, rules=None, detail: bool = False) -> DataFrame:
    """doc_id, the counts, base_failed and kept; with ``detail`` also the failed rules' names."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{WS}]"))
    base = docs.select("doc_id", text.alias("__text"), words_of(F.col("text")).alias("__words"), lines.alias("__lines"))
    counted = base.select("doc_id", *[c.alias(n) for n, c in measures(F.col("__text")).items()])
    per_word = lambda c: F.col(c) / F.greatest(F.col("n_words"), F.lit(1))
    value = {
        "n_words": F.col("n_words").cast("double"),
        "mean_word_chars": per_word("word_chars"),
        "symbol_ratio": per_word("n_symbols"),
        "stop_ratio": per_word("n_stop"),
        "dup_line_ratio": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeat_ratio": per_word("n_repeat_words"),
        "upper_ratio": F.col("n_upper") / F.greatest(F.col("word_chars"), F.lit(1)),
    }
    failed = [
        (name, (F.lit(False) if least is None else value[name] < least) | (F.lit(False) if most is None else value[name] > most))
        for name, least, most in (rules or RULES)
    ]
    base_failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    any_failed = F.lit(False)
    for _, c in failed:
        any_failed = any_failed | c
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"), (~base_failed & ~any_failed).alias("kept")]
    if detail:
        cols.append(F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in failed]), lambda x: x.isNotNull()).alias("failed_rules"))
    return counted.select(*cols)


def oracle_sql() -> str:
    words = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
    # numbers of RULES, written out again for the other engine
    return rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM t),
pos AS (SELECT doc_id, unnest(generate_series(1, len(ws) - 4)) AS i, ws FROM w WHERE len(ws) >= 5),
win AS (SELECT doc_id, i, array_to_string(ws[i:i+4], ' ') AS g FROM pos),
dup AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM dup, (SELECT unnest([0, 1, 2, 3, 4]) AS k) WHERE n > 1 GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
         len(ls) AS n_lines, len(list_filter(ws, lambda x: lower(x) IN ({words}))) AS n_stop,
         length(regexp_replace(text, '\P{{Lu}}+', '', 'g')) AS n_upper
  FROM w LEFT JOIN cov ON w.doc_id = cov.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND word_chars / greatest(n_words, 1) BETWEEN 1.5 AND 20
         AND n_symbols / greatest(n_words, 1) <= 0.10 AND n_stop / greatest(n_words, 1) >= 0.02
         AND n_dup_lines / greatest(n_lines, 1) <= 0.30 AND n_repeat_words / greatest(n_words, 1) <= 0.20
         AND n_upper / greatest(word_chars, 1) <= 0.30 AS kept
FROM m
"""
