"""String functions: normalisation, tokens, symbol names, byte ranges, prompts."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A run of letters, digits and underscores.
TOKEN = r"[\p{IsAlphabetic}\p{N}_]+"
_PY_TOKEN = re.compile(r"\w+")
_EDGE = r"[\p{IsAlphabetic}\p{N}_]"

STOP_WORDS = frozenset(
    word
    for line in (
        "i a me my we it is if in on of or to by do as at be am an up so no",
        "you and are was who why how any all can did had has but for out not its our the",
        "been does from have into just over some such than that them then they this very want",
        "were what when will with your about being could doing there these those their where",
        "while which would should under because against having",
    )
    for word in line.split()
)


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once for each row, lambdas inside included."""
    return F.transform(F.array(value), body)[0]


def normalize(c) -> Column:
    """White space runs (Unicode) become one space, both ends are trimmed."""
    return F.trim(F.regexp_replace(col(c), r"(?U)\s+", " "))


def sha256_hex(c) -> Column:
    return F.sha2(col(c), 256)


def content_hash(c) -> Column:
    return sha256_hex(normalize(c))


def hex16(*parts) -> Column:
    """The first 16 hex digits of the SHA-256 of the parts joined by NUL."""
    return F.substring(F.sha2(F.concat_ws("\0", *[col(p) for p in parts]), 256), 1, 16)


def tokens(c, min_bytes: int = 1) -> Column:
    found = F.regexp_extract_all(col(c), F.lit(TOKEN), F.lit(0))
    return F.filter(found, lambda t: F.octet_length(t) >= min_bytes) if min_bytes > 1 else found


#: Letters with marks and what the index folds them to.
FOLD_FROM = "áàâäãåāçćčéèêëēíìîïñńóòôöõōøúùûüūýÿžźšś"
FOLD_TO = "aaaaaaaccceeeeeiiiinnooooooouuuuuyyzzss"


def fold(c) -> Column:
    """Lower case without diacritics."""
    return F.translate(F.lower(col(c)), FOLD_FROM, FOLD_TO)


def merge_ranges(ranges) -> Column:
    """Sorted, disjoint ranges of an array<struct<start,end>>; touching ones merge, empty ones go."""
    ordered = F.array_sort(F.transform(F.filter(col(ranges), lambda r: r["start"] < r["end"]), lambda r: F.struct(r["start"].cast("bigint").alias("start"), r["end"].cast("bigint").alias("end"))))
    zero = F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)")

    def step(done: Column, r: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], r["end"]).alias("end"))))
        return F.when((F.size(done) > 0) & (r["start"] <= F.try_element_at(done, F.lit(-1))["end"]), joined).otherwise(F.concat(done, F.array(r)))

    return F.aggregate(ordered, zero, step)


def strip_ranges(text, ranges) -> Column:
    """The text without the bytes of the ranges, which are clamped to its length; what is left of a cut character becomes U+FFFD."""
    raw = F.encode(col(text), "UTF-8")
    kept = F.aggregate(
        merge_ranges(ranges),
        F.struct(F.lit(0).cast("bigint").alias("at"), F.encode(F.lit(""), "UTF-8").alias("out")),
        lambda a, r: F.struct(
            F.greatest(a["at"], r["end"]).alias("at"),
            F.concat(a["out"], F.substr(raw, (a["at"] + 1).cast("int"), F.greatest(F.least(r["start"], F.octet_length(raw).cast("bigint")) - a["at"], F.lit(0)).cast("int"))).alias("out"),
        ),
    )
    rest = F.substr(raw, (kept["at"] + 1).cast("int"), F.greatest(F.octet_length(raw) - kept["at"], F.lit(0)).cast("int"))
    return F.make_valid_utf8(F.concat(kept["out"], rest).cast("string"))


def symbol_name(raw, depth: int = 8) -> Column:
    """The bare name of a callee: no macro marks, no generic arguments (nested to ``depth``), last path segment."""
    c = F.regexp_replace(F.trim(col(raw)), "!+$", "")
    for _ in range(depth):
        c = F.regexp_replace(c, "<[^<>]*>", "")
    c = F.regexp_replace(F.regexp_replace(c, "<.*$", ""), ">", "")
    parts = F.filter(F.transform(F.split(c, "[.:]"), lambda p: F.trim(p)), lambda p: p != "")
    last = F.try_element_at(parts, F.lit(-1))
    return F.when(last != "<anonymous>", last)


def symbol_name_exact(raw: str) -> str | None:
    """The same for one string and any depth."""
    out, depth = [], 0
    for ch in raw.strip().rstrip("!"):
        if ch == "<":
            depth += 1
        elif ch == ">":
            depth = max(0, depth - 1)
        elif not depth:
            out.append(ch)
    return next((p for p in (x.strip() for x in reversed(re.split("[.:]", "".join(out)))) if p and p != "<anonymous>"), None)


def declared_name_char(text, name) -> Column:
    """1-based code point of the first whole-word occurrence, 0 for none."""
    pattern = F.concat(F.lit(rf"(?<!{_EDGE})\Q"), col(name), F.lit(rf"\E(?!{_EDGE})"))
    return F.regexp_instr(col(text), pattern)


def declared_name_byte(text, name) -> Column:
    """0-based byte of that occurrence, null for none."""
    at = declared_name_char(text, name)
    return F.when(at > 0, F.octet_length(F.substr(col(text), F.lit(1), at - 1)))


def without_declared_name(text, name) -> Column:
    """The text with its declared name replaced; null where there is none."""
    at = declared_name_char(text, name)
    changed = F.concat(F.substr(col(text), F.lit(1), at - 1), F.lit("<declared-name>"), F.substr(col(text), at + F.length(col(name))))
    return F.when((at > 0) & (col(name) != "<anonymous>"), changed)


def position_of_byte(text, byte) -> Column:
    """0-based line and UTF-16 column of a byte offset; a character that the offset cuts is counted whole."""
    raw, at = F.encode(col(text), "UTF-8"), col(byte).cast("int")
    cut = F.length(F.regexp_extract(F.hex(F.substr(raw, at + 1, F.lit(3))), "^(?:[89AB][0-9A-F])*", 0)) / 2
    head = F.decode(F.substr(raw, F.lit(1), at + cut.cast("int")), "UTF-8")
    line = F.substring_index(head, "\n", -1)
    count = F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit("")))
    return F.struct(count.alias("line"), (F.octet_length(F.encode(line, "UTF-16LE")) / 2).cast("int").alias("column"))


def compress_query(query: str, max_terms: int = 24, min_words: int = 25) -> str | None:
    """The distinctive terms of a narrative query, or None where that gains nothing."""
    if len(query.split()) < min_words:
        return None
    seen: dict[str, str] = {}
    for term in _PY_TOKEN.findall(query):
        low = term.lower()
        if len(term.encode()) >= 3 and low not in STOP_WORDS and low not in seen:
            seen[low] = term
    terms = list(seen.values())[:max_terms]
    short = " ".join(terms)
    return None if len(terms) < 4 or short == query else short


def compressed(c, max_terms: int = 24, min_words: int = 25) -> Column:
    """The same for a column of queries."""
    stop = sorted(STOP_WORDS)
    kept = F.filter(tokens(c, 3), lambda t: ~F.lower(t).isin(stop))
    first = F.aggregate(
        kept,
        F.struct(F.expr("cast(array() as array<string>)").alias("low"), F.expr("cast(array() as array<string>)").alias("out")),
        lambda a, t: F.when(F.array_contains(a["low"], F.lower(t)), a).otherwise(F.struct(F.concat(a["low"], F.array(F.lower(t))).alias("low"), F.concat(a["out"], F.array(t)).alias("out"))),
    )["out"]
    terms = F.slice(first, 1, max_terms)
    words = F.size(F.array_remove(F.split(F.trim(F.regexp_replace(col(c), r"(?U)\s+", " ")), " "), ""))
    short = F.array_join(terms, " ")
    return F.when((words >= min_words) & (F.size(terms) >= 4) & (short != col(c)), short)


def clean_docstring(c) -> Column:
    """The text of a string literal: prefix and quotes off, trimmed; null if unquoted or empty."""
    t = F.regexp_replace(F.trim(col(c)), "^[rRuU]+", "")
    inner = F.lit(None).cast("string")
    for q in ("'", '"', "'''", '"""'):  # the longest that fits wins
        fits = t.startswith(q) & t.endswith(q) & (F.length(t) >= 2 * len(q))
        inner = F.when(fits, F.substr(t, F.lit(len(q) + 1), F.length(t) - 2 * len(q))).otherwise(inner)
    inner = F.trim(F.regexp_replace(inner, r"^\s+|\s+$", ""))
    return F.when(inner != "", inner)


def hover_text(c, cap: int = 2000) -> Column:
    """Fenced blocks without their first line, joined by newlines; the trimmed text where there are none."""
    parts = F.split(col(c), "```")
    blocks = F.filter(parts, lambda _, i: i % 2 == 1)
    body = F.transform(blocks, lambda b: F.when(F.instr(b, "\n") > 0, F.substr(b, F.instr(b, "\n") + 1)).otherwise(b))
    trim = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    body = F.filter(F.transform(body, trim), lambda b: b != "")
    text = F.when(F.size(body) > 0, F.array_join(body, "\n")).otherwise(trim(col(c)))
    return F.when(text != "", F.substring(text, 1, cap))


def callee_tail(callee: str, keep: int) -> str:
    """The last ``keep`` dot segments outside brackets."""
    depth = dots = 0
    for i in range(len(callee) - 1, -1, -1):
        ch = callee[i]
        if ch in ")]>":
            depth += 1
        elif ch in "([<":
            depth = max(0, depth - 1)
        elif ch == "." and not depth:
            dots += 1
            if dots == keep:
                return callee[i + 1 :]
    return callee


def call_site(callee, line) -> Column:
    """Callee without white space and its line, trimmed and cut to 200 characters."""
    return F.struct(F.regexp_replace(col(callee), r"(?U)\s+", "").alias("callee"), F.substring(F.trim(col(line)), 1, 200).alias("snippet"))


def estimated_tokens(c, max_length) -> Column:
    return F.least(F.floor(F.length(col(c)) / 4) + 1, F.greatest(F.lit(1), F.lit(max_length))).cast("bigint")


def unique_label(hint: str, taken) -> str:
    """``hint``, or with the first free number from 2 on."""
    label, k = hint, 2
    while label in taken:
        label, k = f"{hint}-{k}", k + 1
    return label


def contract_diff(stored: dict, offered: dict) -> list[str]:
    """Fields of the stored contract whose value differs in the offered one."""
    return [f"{k} ({v!r} -> {offered.get(k)!r})" for k, v in stored.items() if offered.get(k) != v]
