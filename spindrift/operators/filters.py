"""The metadata filter language: ``key=value`` clauses over units."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ("project", "language", "kind", "name", "scope", "path", "min_nodes", "tests")
POLICIES = ("include", "exclude", "only")


def glob_regex(glob: str, separator: bool) -> str:
    """An anchored regular expression; with ``separator`` one star stops at a slash and two cross it."""
    out, i, n = [], 0, len(glob)
    any_one = "[^/]" if separator else "."
    while i < n:
        ch = glob[i]
        if ch == "*":
            stars = 1
            while i + stars < n and glob[i + stars] == "*":
                stars += 1
            before, after = glob[i - 1] if i else "/", glob[i + stars] if i + stars < n else "/"
            if stars == 2 and before == "/" and after == "/" and separator:
                if i + stars < n:
                    out.append("(?:.*/)?")
                    stars += 1
                else:
                    out.append(".*")
            else:
                out.append(f"{any_one}*")
            i += stars
            continue
        if ch == "?":
            out.append(any_one)
        elif ch == "[":
            end = glob.find("]", i + 2)
            if end < 0:
                raise ValueError(f"an unclosed class in the glob {glob!r}")
            body = glob[i + 1 : end]
            out.append("[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]")
            i = end
        elif ch == "{":
            end = glob.find("}", i)
            if end < 0:
                raise ValueError(f"an unclosed choice in the glob {glob!r}")
            out.append("(?:" + "|".join(glob_regex(g, separator)[1:-1] for g in glob[i + 1 : end].split(",")) + ")")
            i = end
        elif ch == "\\" and i + 1 < n:
            i += 1
            out.append("\\" + glob[i])
        else:
            out.append(ch if ch.isalnum() or ch in "_/-" else "\\" + ch)
        i += 1
    return "^" + "".join(out) + "$"


def looks_like_test(path="relative_path", name="name", scope="scope", kind="kind") -> Column:
    path, name, scope, kind = F.col(path), F.col(name), F.col(scope), F.col(kind)
    base = F.substring_index(path, "/", -1)
    found = (kind == "test") | path.startswith("tests/") | path.contains("/tests/") | path.contains("/test/") | base.startswith("test_") | name.startswith("test_") | name.endswith("_test")
    for suffix in ("_test.go", "_test.py", ".test.ts", ".test.js", "_spec.rb"):
        found = found | path.endswith(suffix)
    return found | F.coalesce(scope == "tests", F.lit(False))


@dataclass
class WhereFilter:
    """Clauses of one key are alternatives; keys must all hold."""

    clauses: dict[str, list[str]] = field(default_factory=dict)
    min_nodes: int | None = None
    tests: str | None = None

    @classmethod
    def parse(cls, text: str) -> WhereFilter:
        out = cls()
        for part in text.split():
            key, eq, value = part.partition("=")
            if not eq:
                raise ValueError(f"{part!r} is no key=value clause")
            if key not in KEYS:
                raise ValueError(f"unknown filter key {key!r}; known: {', '.join(KEYS)}")
            if key == "min_nodes":
                if not value.isdecimal():
                    raise ValueError(f"min_nodes takes a number, not {value!r}")
                out.min_nodes = int(value)
            elif key == "tests":
                if value not in POLICIES:
                    raise ValueError(f"tests takes one of {', '.join(POLICIES)}")
                out.tests = value
            else:
                if key in ("name", "scope", "path"):
                    glob_regex(value, key == "path")
                out.clauses.setdefault(key, []).append(value)
        return out

    @property
    def tests_policy(self) -> str:
        return self.tests or "include"

    def with_default_tests(self, policy: str) -> WhereFilter:
        return WhereFilter(self.clauses, self.min_nodes, self.tests or policy)

    def condition(self) -> Column:
        c = F.lit(True)
        for key, column in (("project", "project_label"), ("language", "language_id"), ("kind", "kind")):
            if key in self.clauses:
                c = c & F.col(column).isin(self.clauses[key])
        for key, column in (("name", "name"), ("scope", "scope"), ("path", "relative_path")):
            if key in self.clauses:
                any_of = F.lit(False)
                for glob in self.clauses[key]:
                    any_of = any_of | F.col(column).rlike(glob_regex(glob, key == "path"))
                c = c & F.coalesce(any_of, F.lit(False))
        if self.min_nodes is not None:
            c = c & (F.col("body_node_count") >= self.min_nodes)
        if self.tests_policy != "include":
            c = c & (looks_like_test() if self.tests_policy == "only" else ~looks_like_test())
        return c


def where(units: DataFrame, expression: str, default_tests: str = "include") -> DataFrame:
    """The units that a filter expression lets through."""
    return units.filter(WhereFilter.parse(expression).with_default_tests(default_tests).condition())


def in_project(units: DataFrame, label: str) -> DataFrame:
    return units.filter(F.col("project_label") == label)


def resolve_selector(units: DataFrame, selector: str) -> DataFrame:
    """The first unit with that ``unit_id``."""
    if not selector.startswith("unit:"):
        raise ValueError("a selector starts with unit:")
    return units.filter(F.col("unit_id") == selector).orderBy("unit_ix").limit(1)


def embeddable_channels(representations: DataFrame) -> DataFrame:
    """The kinds of representations that are embedded, in alphabetical order."""
    return representations.filter(F.col("kind") != "full_source").select("kind").distinct().orderBy("kind")


def apply_retention(representations: DataFrame, mode: str) -> DataFrame:
    """What stays of the contents: all (full), no extracted but full_source (report), none extracted (minimal)."""
    extracted = F.col("origin") == "extracted"
    gone = {"full": F.lit(False), "report": extracted & (F.col("kind") != "full_source"), "minimal": extracted}[mode]
    return representations.withColumn("content", F.when(~gone, F.col("content")))


def representation(representations, kind: str, what: str = "content") -> Column:
    """A field of the first representation of that kind in an array column."""
    rows = F.filter(F.col(representations) if isinstance(representations, str) else representations, lambda r: r["kind"] == kind)
    return F.try_element_at(rows, F.lit(1))[what]
