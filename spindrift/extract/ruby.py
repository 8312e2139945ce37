"""The Ruby frontend: definitions by their keywords and the ends that belong to them."""

from __future__ import annotations

import bisect
import re

from spindrift.extract.rows import Unit, rows_of

_MASK = re.compile(r"^=begin\b.*?^=end\b[^\n]*|#[^\n]*|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|(?<=[=(,\s])/(?![\s/])(?:\\.|[^/\\\n])+/[imxo]*", re.S | re.M)
#: Words that open a block: anywhere, or only at the start of a statement.
_WORDS = re.compile(r"(?<![\w.:@$?!])(?:(?P<any>def|class|module|do|begin|case)|(?P<first>if|unless|while|until|for)|(?P<end>end))(?![\w?!:])|(?P<lambda>->)")
_DEF = re.compile(r"def\s+(?:(?:self|[A-Za-z_]\w*)\s*\.\s*)?(?P<name>[A-Za-z_]\w*[?!=]?|\[\]=?|[+\-*/%<>=!~^&|]+)")
_NAMED = re.compile(r"(?:class|module)\s+(?P<name>[A-Z][\w:]*)")
_TOKEN = re.compile(r"[A-Za-z_@$][\w?!]*|\d[\w.]*|[(\[{]|\x01")


def units(text: str) -> list[Unit]:
    comments, parts, at = [], [], 0
    for m in _MASK.finditer(text):
        parts.append(text[at : m.start()])
        blank = re.sub(r"[^\n]", " ", m.group())
        if m.group()[0] in "#=":
            comments.append((m.start(), m.end()))
        else:
            blank = "\x01" + blank[1:]
        parts.append(blank)
        at = m.end()
    masked = "".join([*parts, text[at:]])
    stack: list[tuple[str, int, str]] = []
    out: list[Unit] = []
    loop_line = -1  # a while or for takes the do of its line
    starts = [a for a, _ in comments]

    def add(kind: str, name: str, start: int, body: int, end: int):
        scope = ".".join(n for k, _, n in stack if k in ("class", "module") and n) or None
        notes = comments[bisect.bisect_left(starts, start) : bisect.bisect_left(starts, end)]
        block, top, k = [], start, bisect.bisect_left(comments, (start,)) - 1
        while k >= 0 and re.fullmatch(r"[ \t]*\n?[ \t]*", text[comments[k][1] : top]) and not text[text.rfind("\n", 0, comments[k][0]) + 1 : comments[k][0]].strip():
            block.append(text[slice(*comments[k])].strip())
            top, k = comments[k][0], k - 1
        out.append(Unit(kind, name, scope, start, body, end, len(_TOKEN.findall(masked, body, end)), notes, "\n".join(reversed(block)) or None))

    for m in _WORDS.finditer(masked):
        line = masked.rfind("\n", 0, m.start()) + 1
        before = masked[line : m.start()]
        if m.group("lambda"):
            brace = re.compile(r"\s*(?:\([^()]*\)|[\w, ]*)\s*\{").match(masked, m.end())
            if brace:
                depth, at = 1, brace.end()
                while at < len(masked) and depth:
                    depth += {"{": 1, "}": -1}.get(masked[at], 0)
                    at += 1
                named = re.search(r"([A-Za-z_@]\w*)\s*=\s*$", before)
                add("closure", named.group(1) if named else "<anonymous>", m.start(), brace.end() - 1, at)
            continue
        word = m.group()
        if m.group("end"):
            if stack:
                kind, start, name = stack.pop()
                if kind == "def":
                    head = re.compile(r"def[^\n(;]*(?:\([^()]*\))?").match(masked, start)
                    add("method", name, start, head.end(), m.end())
            continue
        if m.group("first"):
            # behind a statement these are modifiers
            if before.strip() and not re.search(r"(?:[=({|&,;]|\b(?:then|else|do|return|and|or|not))\s*$", before):
                continue
            loop_line = line if word in ("while", "until", "for") else loop_line
            stack.append((word, m.start(), ""))
            continue
        if word == "do" and line == loop_line:
            loop_line = -1
            continue
        if word == "def":
            d = _DEF.match(masked, m.start())
            short = re.compile(r"def[^\n(=]*(?:\([^()]*\))?\s*=(?![=~])").match(masked, m.start())
            if short and d and not d.group("name").endswith("="):
                stop = masked.find("\n", short.end())
                add("method", d.group("name"), m.start(), short.end(), stop if stop >= 0 else len(masked))
                continue
            stack.append(("def", m.start(), d.group("name") if d else "<anonymous>"))
        elif word in ("class", "module"):
            n = _NAMED.match(masked, m.start())
            stack.append((word, m.start(), n.group("name") if n else ""))
        else:
            stack.append((word, m.start(), ""))
    return sorted(out, key=lambda u: (u.start, u.end))


def extract(text: str, min_nodes: int, max_chars: int) -> list[dict]:
    return rows_of(text, units(text), min_nodes, max_chars)
