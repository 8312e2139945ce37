"""Frontends for languages with braces, by a scanner over masked source.

Comments and the insides of literals are masked with spaces, brackets are paired,
and what stands before each opening brace says whether the block is a unit, a
scope or neither. That finds the same definitions as a grammar would in
well-formed source; macros that hide braces are beyond it. ``body_node_count``
counts the names, literals and bracket pairs of the body.
"""

from __future__ import annotations

import bisect
import re
from dataclasses import dataclass, field

from spindrift.extract.rows import Unit, rows_of

_LINE, _BLOCK = r"//[^\n]*", r"/\*.*?(?:\*/|\Z)"
_DQ, _SQ = r'"(?:\\.|[^"\\\n])*"', r"'(?:\\.|[^'\\\n])*'"
_NAME = r"[A-Za-z_$][\w$]*"
_PATH = rf"{_NAME}(?:(?:::|\.){_NAME})*"
_ARGS = r"\([^()]*(?:\([^()]*(?:\([^()]*\)[^()]*)*\)[^()]*)*\)"
_FLOW = {"if", "for", "while", "switch", "catch", "else", "do", "return", "sizeof", "synchronized", "using", "lock", "fixed", "foreach", "with", "when", "match", "loop", "unsafe", "try", "finally", "new", "throw", "case", "elseif", "await", "yield", "in"}


@dataclass(frozen=True)
class Language:
    """How a language's source is masked and which headers make units and scopes.

    units: (kind, pattern on the header with groups ``name`` and maybe ``scope``);
    lambdas: (kind, pattern that ends where the body starts).
    """

    id: str
    extensions: tuple[str, ...]
    mask: str
    units: tuple[tuple[str, str], ...]
    scopes: tuple[str, ...] = ()
    lambdas: tuple[tuple[str, str], ...] = ()
    line_comments: tuple[str, ...] = ("//",)
    calls: str | None = None
    own_scope: bool = field(default=True)
    newline_ends: bool = False
    prefix: str | None = None  # what stands before a definition without being part of it


_C_FUNCTION = rf"(?:^|[\s*&>])(?P<name>(?:{_NAME}::)*~?(?:{_NAME}|operator\s*[^\s(]+))\s*{_ARGS}\s*(?:const|noexcept(?:{_ARGS})?|override|final|mutable|volatile|throw\s*{_ARGS}|->\s*[^{{;]+|:\s*[^:{{;][^;{{]*|try|&&?|\s)*$"
_METHOD = rf"(?P<before>(?:[\w\]>?*&$.\s@,\[<]|{_ARGS})*?[\w\]>?]\s+)(?P<name>{_NAME})\s*(?:<[^<>()]*>\s*)?{_ARGS}\s*(?:throws\s+[\w.,\s]+|where\s+[^{{]+)?$"
_CONSTRUCTOR = rf"^(?:(?:@{_NAME}(?:{_ARGS})?|\[[^\]]*\])\s*)*(?:(?:public|private|protected|internal|static|extern)\s+)*(?P<name>{_NAME})\s*{_ARGS}\s*(?:throws\s+[\w.,\s]+|:\s*(?:base|this)\s*{_ARGS}\s*)?$"
_JS_METHOD = rf"^(?:(?:public|private|protected|static|async|override|readonly|abstract|get|set|@{_NAME}(?:{_ARGS})?)\s+)*\*?\s*(?P<name>[#]?{_NAME}|\[[^\]]*\])\s*(?:<[^()]*>)?\s*{_ARGS}\s*(?::\s*[^{{;=]+)?$"
_JS_FUNCTION = rf"(?:^|\s|\b)(?:async\s+)?function\s*\*?\s+(?P<name>{_NAME})\s*(?:<[^()]*>)?\s*{_ARGS}\s*(?::\s*[^{{;=]+)?$"
_ARROW = rf"(?:async\s+)?(?:{_ARGS}\s*(?::\s*[\w<>\[\]|.\s]+?)?|{_NAME})\s*=>\s*"
_FUNCTION_EXPRESSION = rf"(?:async\s+)?function\s*\*?\s*(?:{_NAME})?\s*{_ARGS}\s*(?::\s*[\w<>\[\]|.\s]+?)?(?={{)"
_JS_MASK = rf"{_LINE}|{_BLOCK}|{_DQ}|{_SQ}|`(?:\\.|[^`\\])*`|(?:(?<=[=(,:\[!&|?{{}};\n])|(?<=return))[ \t]*/(?![/*])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*"
_C_MASK = rf"{_LINE}|{_BLOCK}|{_DQ}|{_SQ}|^[ \t]*#[^\n]*(?:\\\n[^\n]*)*"


def _js(id_: str, extensions: tuple[str, ...]) -> Language:
    return Language(
        id_, extensions, _JS_MASK,
        (("function", _JS_FUNCTION), ("method", _JS_METHOD)),
        (rf"\bclass\s+(?P<name>{_NAME})[^{{;]*$",),
        (("closure", _ARROW), ("closure", _FUNCTION_EXPRESSION)), newline_ends=True,
    )


LANGUAGES = {
    x.id: x
    for x in (
        Language("c", ("c", "h"), _C_MASK, (("function", _C_FUNCTION),)),
        Language(
            "cpp", ("cc", "cpp", "cxx", "c++", "hpp", "hh", "hxx", "h++"), rf"R\"(?P<d>[^(\s]*)\(.*?\)(?P=d)\"|{_C_MASK}", (("function", _C_FUNCTION),),
            (rf"\b(?:class|struct)\s+(?:[A-Z_]+\s+)?(?P<name>{_NAME})\s*(?:final\s*)?(?::[^:{{;][^{{;]*)?$", rf"\bnamespace\s+(?P<name>{_PATH})\s*$"),
            (("closure", rf"\[[^\[\]]*\]\s*(?:{_ARGS})?\s*(?:mutable|noexcept|->\s*[\w:<>&*\s]+?|\s)*(?={{)"),), prefix=r"(?:public|private|protected)\s*:\s*",
        ),
        Language(
            "csharp", ("cs",), rf"{_LINE}|{_BLOCK}|[$]?@\"(?:\"\"|[^\"])*\"|[$]?{_DQ}|{_SQ}|^[ \t]*#[^\n]*", (("constructor", _CONSTRUCTOR), ("method", _METHOD)),
            (rf"\b(?:class|struct|interface|record)\s+(?P<name>{_NAME})[^{{;]*$",), (("lambda", rf"(?:{_ARGS}|{_NAME})\s*=>\s*"),),
        ),
        Language(
            "go", ("go",), rf"{_LINE}|{_BLOCK}|{_DQ}|{_SQ}|`[^`]*`",
            (("method", rf"^func\s*\(\s*(?:{_NAME}\s+)?(?P<scope>[*&]?\s*{_PATH}(?:\[[^\]]*\])?)\s*\)\s*(?P<name>{_NAME})\s*{_ARGS}.*$"), ("function", rf"^func\s+(?P<name>{_NAME})\s*(?:\[[^\]]*\])?\s*{_ARGS}.*$")),
            (), (("closure", rf"\bfunc\s*{_ARGS}\s*(?:{_ARGS}|[\w.*\[\]]+)?\s*(?={{)"),), own_scope=False, newline_ends=True,
        ),
        Language(
            "java", ("java",), rf"\"\"\".*?\"\"\"|{_LINE}|{_BLOCK}|{_DQ}|{_SQ}", (("constructor", _CONSTRUCTOR), ("method", _METHOD)),
            (rf"\b(?:class|interface|enum)\s+(?P<name>{_NAME})[^{{;]*$",), (("lambda", rf"(?:{_ARGS}|{_NAME})\s*->\s*"),),
        ),
        _js("javascript", ("js", "jsx", "mjs", "cjs")),
        Language(
            "kotlin", ("kt", "kts"), rf"\"\"\".*?\"\"\"|{_LINE}|{_BLOCK}|{_DQ}|{_SQ}",
            (("function", rf"\bfun\s+(?:<[^()]*?>\s*)?(?:[\w.<>?, ]+\.)?(?P<name>{_NAME})\s*{_ARGS}\s*(?::\s*[^={{]+)?$"), ("constructor", rf"\b(?P<name>constructor)\s*{_ARGS}\s*(?::\s*(?:this|super)\s*{_ARGS}\s*)?$")),
            (rf"\b(?:class|object)\s+(?P<name>{_NAME})[^{{;]*$",), (("closure", rf"\bfun\s*{_ARGS}\s*(?::\s*[\w<>?.]+\s*)?(?={{)"), ("lambda", r"(?<=[(,=)\w>])\s*(?=\{\s*(?:[\w,:<>?\s()]+->|it\b))")), newline_ends=True,
        ),
        Language(
            "php", ("php", "phtml"), rf"\A.*?<\?php|\?>.*?(?:<\?php|\Z)|{_LINE}|#(?!\[)[^\n]*|{_BLOCK}|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'",
            (("function", rf"\bfunction\s+&?\s*(?P<name>{_NAME})\s*{_ARGS}\s*(?::\s*[?\w|\\\s]+)?$"),),
            (rf"\b(?:class|interface|trait)\s+(?P<name>{_NAME})[^{{;]*$",), (("closure", rf"\bfunction\s*&?\s*{_ARGS}\s*(?:use\s*{_ARGS}\s*)?(?::\s*[?\w|\\]+\s*)?(?={{)"),), line_comments=("//", "#"),
        ),
        Language(
            "rust", ("rs",), rf"r(?P<h>#*)\".*?\"(?P=h)|{_LINE}|{_BLOCK}|\"(?:\\.|[^\"\\])*\"|'(?:\\[^\n']+|[^'\\\n])'",
            (("function", rf"\bfn\s+(?P<name>{_NAME})\b.*$"),),
            (r"\bimpl\b(?:\s*<(?:[^<>]|<[^<>]*>)*>)?\s*(?:.*?\bfor\s+)?(?P<name>[^{]+?)\s*(?:\bwhere\b.*)?$", rf"\btrait\s+(?P<name>{_NAME})[^;]*$", rf"\bmod\s+(?P<name>{_NAME})\s*$"),
            (("closure", r"(?:(?<=[(,=;{}\s])|(?<=\bmove))\|(?:[^|\n;{}]|\n)*?\|\s*(?:->\s*[\w:<>&\s]+?(?=\{))?"),),
            calls=rf"(?P<callee>{_PATH}(?:::<[^()]*?>)?)\s*(?P<how>!\s*[(\[{{]|\()", prefix=r"(?:#!?\[[^\n]*?\]\s*)+",
        ),
        _js("typescript", ("ts", "tsx", "mts", "cts")),
    )
}

_PAIRS = {")": "(", "]": "[", "}": "{"}
_TOKEN = re.compile(r"[A-Za-z_$][\w$]*|\d[\w.]*|[({\[]|\x01")


class Source:
    """One document: masked text, comments, bracket pairs."""

    def __init__(self, text: str, language: Language):
        self.text, self.language, self.comments = text, language, []
        parts, at = [], 0
        for m in re.finditer(language.mask, text, re.S | re.M):
            raw = m.group()
            parts.append(text[at : m.start()])
            at = m.end()
            note = raw.lstrip().startswith(("//", "/*", "#")) and not (raw.lstrip().startswith("#") and "#" not in language.line_comments)
            if note:
                self.comments.append((m.start(), m.end()))
            blank = re.sub(r"[^\n]", " ", raw)
            # a literal counts once
            parts.append(blank if note or len(raw) < 2 or raw.lstrip()[0] in "#<?" else blank[:1].replace(" ", "\x01") + blank[1:])
        self.masked = "".join([*parts, text[at:]])
        self.match: dict[int, int] = {}
        open_: list[int] = []
        for m in re.finditer(r"[()\[\]{}]", self.masked):
            c = m.group()
            if c in "([{":
                open_.append(m.start())
            else:
                while open_ and self.masked[open_[-1]] != _PAIRS[c]:
                    open_.pop()
                if open_:
                    a = open_.pop()
                    self.match[a], self.match[m.start()] = m.start(), a

    def header(self, brace: int) -> int:
        """Where what stands before a brace starts: after a ; { } or an open bracket."""
        at = brace - 1
        while at >= 0:
            c = self.masked[at]
            if c in ")]" and at in self.match:
                at = self.match[at]
            elif c in ";{}([":
                break
            elif c == "\n" and self.language.newline_ends and (line := self.masked[at:brace].lstrip()) and not re.match(r"(?:extends|implements|where|throws)\b|[:)\]]", line):
                break
            at -= 1
        return at + 1

    def expression_end(self, at: int) -> int:
        """The end of an expression: before a , ; or the bracket that closes around it."""
        n = len(self.masked)
        while at < n:
            c = self.masked[at]
            if c in "([{":
                if at not in self.match:
                    return n
                at = self.match[at]
            elif c in ",;)]}":
                return at
            at += 1
        return n


def _anonymous(src: Source, start: int, outer: str) -> str:
    """A name from the declaration, key or assignment that takes the function, else from the receiving call, else of its surroundings."""
    before = src.masked[max(0, start - 200) : start]
    if m := re.search(rf"(?:\b(?:const|let|var|val|auto|mut)\s+)?({_NAME})(?:\s*:\s*[^=;{{}}()]*)?\s*(?::=|=|:)\s*(?:async\s+|move\s+|static\s+)*$", before):
        return m.group(1)
    call = re.search(rf"({_PATH})\s*\((?:\s*\x01 *,)?[^()]*$", before)
    if call and call.group(1) not in _FLOW and len(call.group(1)) <= 40:
        inside = src.text[max(0, start - 200) + call.end(1) : start]
        label = re.match(r"\s*\(\s*([\"'`])(.{1,48}?)\1", inside)
        return f'{call.group(1)}("{label.group(2)}")' if label else f"{call.group(1)}(...)"
    return f"{outer}.func" if outer else "<anonymous>"


def _test_scope(src: Source, start: int) -> bool:
    """Whether the item that starts here carries an enabled cfg(test)."""
    head = src.text[max(0, start - 300) : start]
    m = re.search(r"((?:#\[[^\n]*\]\s*)+)(?:pub\s+)?$", head)
    return bool(m and re.search(r"cfg\((?:[^()]|\((?:[^()])*\))*\btest\b", re.sub(r"not\s*\([^()]*\)", "", m.group(1))))


def units(text: str, language: Language) -> list[Unit]:
    """The units of a document, by position."""
    src = Source(text, language)
    masked, found, scopes = src.masked, [], []  # scopes: start, end, name
    for m in re.finditer(r"\{", masked):
        brace = m.start()
        if brace not in src.match:
            continue
        start, end = src.header(brace), src.match[brace] + 1
        start += len(masked[start:brace]) - len(masked[start:brace].lstrip())
        if language.prefix and (p := re.match(language.prefix, masked[start:brace])):
            start += p.end()
        head = masked[start:brace].rstrip()
        if not head or len(head) > 4000:
            continue
        for pattern in language.scopes:
            if s := re.search(pattern, head, re.S):
                test = language.id == "rust" and _test_scope(src, start)
                scopes.append((start, end, "tests" if test else " ".join(s.group("name").split())))
                break
        else:
            for kind, pattern in language.units:
                u = re.search(pattern, head, re.S)
                if not u or u.group("name").split("::")[-1] in _FLOW or re.search(r"=>\s*$|(?<![=!<>])=\s*$", head):
                    continue
                if kind == "method" and language.id in ("java", "csharp") and re.search(r"\b(?:new|return|throw|else|await)\s*$", u.group("before")):
                    continue
                if kind == "constructor" and language.id in ("java", "csharp") and not (scopes and u.group("name") == scopes[-1][2]):
                    continue
                if kind == "method" and language.id in ("javascript", "typescript") and not _in_class(src, start, scopes):
                    continue
                own = u.groupdict().get("scope")
                found.append([kind, u.group("name"), own.strip().lstrip("*& ") if own else None, start, brace, end])
                break
    taken = {f[4] for f in found}
    for kind, pattern in language.lambdas:
        for m in re.finditer(pattern, masked):
            body = m.end()
            while body < len(masked) and masked[body] in " \t\n":
                body += 1
            if body in taken or body >= len(masked):
                continue
            if masked[body] == "{":
                if body not in src.match:
                    continue
                end = src.match[body] + 1
            else:
                end = src.expression_end(body)
            start = m.start() + len(m.group()) - len(m.group().lstrip())
            if end > body and not re.search(r"\b(?:if|for|while|switch|catch|match|case)\s*$", masked[max(0, start - 12) : start]):
                taken.add(body)
                found.append([kind, None, None, start, body, end])
    found.sort(key=lambda f: (f[3], f[5]))
    out: list[Unit] = []
    seen: set[tuple[int, int]] = set()
    outer: list[tuple[int, str]] = []
    starts = [a for a, _ in src.comments]
    for kind, name, own, start, body, end in found:
        if (start, end) in seen:
            continue
        seen.add((start, end))
        while outer and outer[-1][0] <= start:
            outer.pop()
        name = name or _anonymous(src, start, outer[-1][1] if outer else "")
        outer.append((end, name))
        around = [n for a, b, n in scopes if a < start and end <= b] if language.own_scope else []
        if language.id == "php" and kind == "function" and around:
            kind = "method"
        if language.id == "csharp" and kind == "method" and len(outer) > 1:
            kind = "function"
        scope = own or ("tests" if language.id == "rust" and ("tests" in around or _test_scope(src, start)) else ".".join(around)) or None
        nodes = len(_TOKEN.findall(masked, body, end))
        notes = src.comments[bisect.bisect_left(starts, start) : bisect.bisect_left(starts, end)]
        out.append(Unit(kind, name, scope, start, body, end, nodes, notes, leading_comment(src, start)))
    if language.calls:
        for m in re.finditer(language.calls, masked):
            callee = re.sub(r"::<.*", "", m.group("callee"))
            if callee in _FLOW or re.search(r"\bfn\s+$", masked[max(0, m.start() - 8) : m.start()]):
                continue
            inner = [u for u in out if u.start <= m.start() < u.end]
            if inner:
                max(inner, key=lambda u: u.start).calls.append((callee + ("!" if m.group("how").startswith("!") else ""), m.start()))
    return out


def _in_class(src: Source, start: int, scopes: list) -> bool:
    """Whether a header stands directly in a class or object literal and not in a function's body."""
    depth_open = [a for a, b, _ in scopes if a < start < b]
    if not depth_open:
        return False
    brace = src.masked.find("{", depth_open[-1])
    at = start - 1
    while at > brace:
        c = src.masked[at]
        if c in ")]}" and at in src.match:
            at = src.match[at]
        elif c in "([{":
            return False
        at -= 1
    return True


def leading_comment(src: Source, start: int) -> str | None:
    """The comments right above a definition, attributes and annotations between them and it left aside."""
    block, at = [], start
    k = bisect.bisect_left(src.comments, (start,)) - 1
    while k >= 0:
        a, b = src.comments[k]
        between = src.text[b:at]
        if re.fullmatch(r"[ \t]*\n?[ \t]*", between) or (not block and re.fullmatch(r"\s*(?:(?:#\[[^\n]*\]|@\w[^\n]*|\[[^\n]*\])\s*)+", between)):
            line = src.text.rfind("\n", 0, a) + 1
            if src.text[line:a].strip():
                break  # a comment behind code
            block.append(src.text[a:b].strip())
            at, k = a, k - 1
        else:
            break
    return "\n".join(reversed(block)) or None


def extract(text: str, language: Language, min_nodes: int, max_chars: int) -> list[dict]:
    return rows_of(text, units(text, language), min_nodes, max_chars)
