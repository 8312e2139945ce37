"""From the places of units to rows with representations, the same for all frontends that scan text."""

from __future__ import annotations

import bisect
import hashlib
import re
from dataclasses import dataclass, field

_WORD = re.compile(r"\w")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "replace")).hexdigest()


def normalized(text: str) -> str:
    return " ".join(text.split())


@dataclass
class Unit:
    """A unit by character offsets: where it, its body and its end are, and the comments inside."""

    kind: str
    name: str
    scope: str | None
    start: int
    body: int
    end: int
    nodes: int
    comments: list[tuple[int, int]]
    documentation: str | None
    calls: list[tuple[str, int]] = field(default_factory=list)


def declared_name(text: str, name: str) -> int | None:
    """Where a name stands as a whole word."""
    at = text.find(name)
    while at >= 0:
        end = at + len(name)
        if not (at and _WORD.match(text[at - 1])) and not (end < len(text) and _WORD.match(text[end])):
            return at
        at = text.find(name, at + 1)
    return None


def rows_of(text: str, found: list[Unit], min_nodes: int, max_chars: int) -> list[dict]:
    """The rows of the units that are large and small enough."""
    to_byte = byte_offsets(text)
    lines = [0, *(m.end() for m in re.finditer("\n", text))]
    out = []
    for u in found:
        whole = text[u.start : u.end]
        if u.nodes < min_nodes or not whole.strip() or len(whole) > max_chars:
            continue
        kept, at = [], u.start
        for a, b in u.comments:
            kept.append(text[at:a])
            at = max(at, b)
        implementation = "".join([*kept, text[at : u.end]])
        head, body = text[u.start : u.body], text[u.body : u.end]
        reps = [("full_source", sha(whole), whole), ("implementation", sha(normalized(implementation)), implementation), ("body", sha(normalized(body)), body)]
        last = u.name.split("::")[-1]
        if (named := declared_name(head, last)) is not None:
            changed = whole[:named] + "<declared-name>" + whole[named + len(last) :]
            reps.append(("body_without_declared_name", sha(normalized(changed)), changed))
        signature = normalized(head) or whole.split("\n", 1)[0].strip()
        reps.append(("signature", sha(signature), signature))
        if u.documentation:
            reps.append(("documentation", sha(u.documentation), u.documentation))
        reps.append(("symbol", sha(u.name), u.name))
        line_of = lambda at: _bisect(lines, at)
        calls = []
        for callee, at in u.calls:
            n = line_of(at)
            stop = text.find("\n", at)
            calls.append({"callee": callee, "snippet": text[lines[n - 1] : stop if stop >= 0 else len(text)].strip()[:200], "line": n})
        out.append({
            "kind": u.kind, "name": u.name, "scope": u.scope, "start_byte": to_byte(u.start), "end_byte": to_byte(u.end), "start_line": line_of(u.start), "end_line": line_of(max(u.start, u.end - 1)),
            "body_node_count": u.nodes, "source_hash": sha(whole), "normalized_body_hash": sha(normalized(body)),
            "representations": [{"kind": k, "content_hash": h, "content": c, "origin": "extracted"} for k, h, c in reps], "references": sorted(calls, key=lambda c: c["line"]),
        })
    return out


def _bisect(lines: list[int], at: int) -> int:
    return bisect.bisect_right(lines, at)


def byte_offsets(text: str):
    if text.isascii():
        return lambda at: at
    step = 4096
    marks = [0]
    for k in range(0, len(text), step):
        marks.append(marks[-1] + len(text[k : k + step].encode("utf-8", "replace")))
    return lambda at: marks[at // step] + len(text[at // step * step : at].encode("utf-8", "replace"))
