"""HTML extraction by nearest-URL page differencing (operator 5).

A page's markup is cut into lines, the blocks of its text. What elements say
about themselves goes first: navigation, header, footer, sidebar, form, script,
style and the like, and elements whose class, id or role names such a part as a
whole (``ad-slot``, but not ``search-algorithms``). Bare words that an article
may use too (``_WEAK``) count only for blocks that are mostly links. An article
within an article that has text is a reader's comment, and so is what follows a
heading that says so, to the end of its section.

Pages are then paired by URL: within a host, ordered by path, each page meets
its neighbours of other content, ``REACH`` to each side (equal pages stand for
one, however many there are). The lines are aligned by longest common
subsequence with the nearest neighbour that isn't a copy, and those that the two
share are deleted, inside article elements as well. A neighbour is a copy if it
has more than half of the page's characters that aren't in most neighbours. If
this would take more than half of what the page's article elements hold, the
neighbours are taken for versions of the article, and it stays whole.

Of the lines left, those inside article and main elements are the text, unless
those outside have more than twice as many characters; then these are.

The neighbours come from a range partition by (host, path, page) with the pages'
order inside it; each partition's edge pages are looked up from a table of the
partitions' first and last pages, so a host of any size spreads over many tasks.
An alignment of very long pages takes memory in proportion to their lines.

A null or empty html is an empty page. A null URL is a host of its own. Repeated
rows are each extracted, alike. Of several longest alignments one is taken, the
same for equal pages. An empty table gives none. Other columns are ignored.
"""

from __future__ import annotations

import bisect
import html as _html
import itertools
import re
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import NULL_ID, checkpointed, shuffle_partitions

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"\b(?:class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_RAW = {"script", "style", "textarea", "title", "xmp", "noframes", "template"}
_NEVER = {"nav", "header", "footer", "aside", "form", "script", "style", "noscript", "template", "iframe", "button", "select", "option", "textarea", "input", "title", "head", "svg", "canvas", "object", "dialog", "menu", "label", "fieldset", "xmp", "noframes", "audio", "video", "map"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "ruby", "rb", "rp", "rt", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
#: Words that name a part which isn't main text, ...
_PART = re.compile(
    r"ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|nav|navbar|navigation|menu\w*|breadcrumbs?|sidebar\w*|aside|footer|header|masthead|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscri\w+|signup|login|"
    r"sharing|social\w*|recommend\w*|comments?|commentlist|disqus|widgets?|toolbar|pagination|pager|copyright|contentinfo|complementary",
)
#: ... words that do so or belong to an article, ...
_WEAK = re.compile(r"search|legal|related|discussion|side|share|hidden|skip|respond|response|reply|replies")
#: ... and words beside these that don't change what they say.
_FRAME = re.compile(
    r"box|bar|list|items?|links?|block|form|wrap|wrapper|container|section|area|unit|slot|buttons?|posts?|articles?|stor(?:y|ies)|panel|content|top|bottom|left|right|main|site|page|global|primary|secondary|inner|outer|text|body|the|js|c|l|\d+|\w"
)
_COMMENTS = re.compile(r"\W*\d*\W*(?:(?:reader|user|your)\W+)?(?:comments?|replies|responses|kommentare?|commentaires?|comentarios?)(?:\W+\d*)*", re.I)
_MAIN = {"article", "main"}
#: Neighbours of other content that are looked at to each side.
REACH = 3
#: Cells of an alignment's table that are held at once.
CELLS = 4_000_000

ARTICLE, OTHER = 2, 1


def part_of(attributes: str) -> int:
    """2 if a class, id or role names a part that isn't main text, 1 if it may, else 0."""
    found = 0
    for a, b, c in _ATTR.findall(attributes):
        for token in (a or b or c).lower().split():
            words = re.split(r"[-_]+", token.strip("-_"))
            named = [w for w in words if not _FRAME.fullmatch(w)]
            if named and all(_PART.fullmatch(w) or _WEAK.fullmatch(w) for w in named):
                strong = any(_PART.fullmatch(w) for w in named) or len(words) > len(named)
                found = max(found, 2 if strong else 1)
    return found


def blocks(source: str | None) -> list[tuple[int, str]]:
    """(place, text) of the blocks outside the never-main parts, in page order."""
    if not source:
        return []
    out: list[tuple[int, str]] = []
    text: list[str] = []
    stack: list[list] = []  # name, whether it is never main text, whether it is an article, whether it may be none
    never = article = weak = link = linked = 0
    told = 0  # characters of the article so far

    def end_block():
        nonlocal linked, told
        if text:
            t = " ".join(_html.unescape("".join(text)).split())
            text.clear()
            if t and not (weak and 2 * linked > len(t)):
                out.append((ARTICLE if article else OTHER, t))
                told += len(t) if article else 0
                if stack and stack[-1][0] in ("h2", "h3", "h4", "h5", "h6") and _COMMENTS.fullmatch(t):
                    return len(stack) > 1 and stack[-2][0] in ("section", "div")
        linked = 0
        return False

    at, n = 0, len(source)
    while at < n:
        m = _TOKEN.search(source, at)
        stop = m.start() if m else n
        if stop > at and not never:
            text.append(source[at:stop])
            linked += (stop - at) if link else 0
        if not m:
            break
        at = m.end()
        name = (m.group(3) or "").lower()
        if not name:
            if m.group(1) and not never:
                text.append(_html.escape(m.group(1), False))
            continue
        if m.group(2):
            if name not in _INLINE and end_block():
                out.pop()
                if not stack[-2][1]:  # the rest of the section is comments
                    stack[-2][1] = True
                    never += 1
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    for was, x, y, z in stack[k:]:
                        never -= x
                        article -= y
                        weak -= z
                        link -= was == "a"
                    del stack[k:]
                    break
                if stack[k][0] in ("article", "main", "body", "table") and name in ("p", "b", "i", "a", "span", "li"):
                    break  # a stray end tag doesn't close what is around it
            continue
        if name in _VOID:
            if name == "hr":
                end_block()
            elif not never:
                text.append(" ")
            continue
        if name not in _INLINE:
            end_block()
        if name == "p":
            _close(stack, "p")
        bad, may = name in _NEVER and not (name == "header" and article), False
        if not bad and name not in ("main", "body", "html", "p", "h1") and m.group(4):
            part = part_of(m.group(4))
            bad, may = part == 2, part == 1
        if name == "article":
            if not article:
                told = 0
            elif any(s[0] == "article" for s in stack):
                bad |= told >= 80  # a comment on the one around it
        good = name in _MAIN
        if name in _RAW:
            end = re.compile(rf"</{name}\b[^>]*>", re.I).search(source, at)
            at = end.end() if end else n
            continue
        if m.group(4).endswith("/") and name not in ("p", "div"):
            continue
        stack.append([name, bad, good, may])
        never += bad
        article += good
        weak += may
        link += name == "a"
    end_block()
    return out


def _close(stack: list, paragraph: str) -> None:
    """A new paragraph ends an open one."""
    for k in range(len(stack) - 1, max(-1, len(stack) - 8), -1):
        if stack[k][0] == paragraph:
            if not any(x or y or z or name == "a" for name, x, y, z in stack[k:]):
                del stack[k:]
            return
        if stack[k][0] not in _INLINE:
            return


def candidates(source: str | None) -> tuple[list[str], list[bool]]:
    """The lines that may be main text, and for each whether it comes from an article or main element."""
    found = blocks(source)
    return [t for _, t in found], [p == ARTICLE for p, _ in found]


def main_text(lines: list[str], inside: list[bool], gone: list[int]) -> str:
    """The lines of the article among those not deleted."""
    drop = set(gone)
    left = [k for k in range(len(lines)) if k not in drop]
    size = [sum(len(lines[k]) for k in left if inside[k] == x) for x in (False, True)]
    return "\n".join(lines[k] for k in left if inside[k] == (size[0] <= 2 * size[1]))


def _lcs_row(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of u with every prefix of v."""
    row = np.zeros(len(v) + 1, np.int32)
    for c in u:
        row[1:] = np.maximum(row[1:], (row[:-1] + 1) * (v == c))
        np.maximum.accumulate(row, out=row)
    return row


def _lcs(u: np.ndarray, v: np.ndarray) -> list[int]:
    """Places in u of one longest common subsequence with v, in memory that grows with their lengths alone."""
    if not len(u) or not len(v):
        return []
    if len(u) == 1:
        return [0] if (v == u[0]).any() else []
    if len(u) * len(v) > CELLS:
        mid = len(u) // 2
        both = _lcs_row(u[:mid], v) + _lcs_row(u[:mid - 1:-1], v[::-1])[::-1]
        cut = int(both.argmax())
        return _lcs(u[:mid], v[:cut]) + [mid + i for i in _lcs(u[mid:], v[cut:])]
    rows = [np.zeros(len(v) + 1, np.int32)]
    for c in u:
        up = rows[-1]
        rows.append(np.maximum.accumulate(np.concatenate([[0], np.maximum(up[1:], (up[:-1] + 1) * (v == c))]).astype(np.int32)))
    i, j, found = len(u), len(v), []
    while i and j:
        if rows[i][j] == rows[i - 1][j]:
            i -= 1
        elif rows[i][j] == rows[i][j - 1]:
            j -= 1
        else:
            found.append(i - 1)
            i, j = i - 1, j - 1
    return found[::-1]


def common_lines(a: list, b: list) -> set[int]:
    """Places in a of one longest common subsequence of lines with b."""
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    found = {*range(lo), *range(len(a) - hi, len(a))}
    x, y = a[lo : len(a) - hi], b[lo : len(b) - hi]
    both = set(x) & set(y)  # other lines can't be part of it
    if not both:
        return found
    code = {t: k for k, t in enumerate(both)}
    xi = [i for i, t in enumerate(x) if t in both]
    u, v = np.array([code[x[i]] for i in xi], np.int32), np.array([code[t] for t in y if t in both], np.int32)
    return found | {lo + xi[i] for i in _lcs(u, v)}


def deleted(lines: list, sizes: list[int], inside: list[bool], neighbours: list[list]) -> list[int]:
    """Places of the lines that a page shares with the nearest neighbour that isn't its copy."""
    seen = [set(x) for x in neighbours]
    often = [len(seen) >= 3 and 2 * sum(t in s for s in seen) > len(seen) for t in lines]
    own = sum(n for n, o in zip(sizes, often) if not o)
    for other in neighbours:
        shared = common_lines(lines, other)
        if 2 * sum(sizes[i] for i in shared if not often[i]) <= own:
            taken = sum(sizes[i] for i in shared if inside[i])
            whole = sum(n for n, x in zip(sizes, inside) if x)
            return sorted(i for i in shared if not inside[i] or 2 * taken <= whole)
    return []


def url_key(url: str | None) -> tuple[str, str]:
    """(host, path) by which pages are paired; scheme, query and fragment don't count."""
    try:
        u = urlsplit(url or "")
    except ValueError:
        return "", url or ""
    return (u.netloc or "").lower(), u.path.rstrip("/").removesuffix(".html")


_KEYS = "page_id bigint, fp bigint, host string, path string, hashes array<bigint>, sizes array<int>, inside array<boolean>"


def _fp():
    return F.xxhash64(F.coalesce(F.col("url"), F.lit("")), F.coalesce(F.col("html"), F.lit("")))


def page_keys(pages: DataFrame) -> DataFrame:
    """For each page its host, path and the hashes and sizes of its lines, without their text."""

    def run(batches):
        for b in batches:
            cols: list[list] = [[] for _ in range(5)]
            for url, source in zip(b.column(2).to_pylist(), b.column(3)):
                lines, inside = candidates(source.as_py())
                hashes = [xxhash.xxh3_64_intdigest(t) - (1 << 63) for t in lines]
                for c, v in zip(cols, (*url_key(url), hashes, [len(t) for t in lines], inside)):
                    c.append(v)
            types = (pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.bool_()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, t) for c, t in zip(cols, types))], names=["page_id", "fp", "host", "path", "hashes", "sizes", "inside"])

    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), _fp().alias("fp"), "url", "html").mapInArrow(run, _KEYS)


def _edges(batches):
    """The first and last REACH pages of other content of each partition, for its first and last host."""
    from pyspark import TaskContext

    first, last, n, start = [], [], 0, None
    for b in batches:
        for host, hashes in zip(b.column(2).to_pylist(), b.column(4).to_pylist()):
            row = (n, host, hashes)
            start = host if n == 0 else start
            n += 1
            if host == start and len(first) < REACH and all(r[2] != hashes for r in first):
                first.append(row)
            if last and last[-1][1] != host:
                last = []
            if all(r[2] != hashes for r in last):
                last = [*last, row][-REACH:]
    rows = first + [r for r in last if all(r[0] != x[0] for x in first)]
    pid = TaskContext.get().partitionId()
    yield pa.RecordBatch.from_arrays(
        [pa.array([pid] * len(rows), pa.int32()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.list_(pa.int64()))],
        names=["pid", "k", "host", "hashes"],
    )


def _near(before: list[list], after: list[list], own: list) -> list[list]:
    """The neighbours of other content, nearest first; before and after are in the order of their distance."""
    out: list[list] = []
    for x in (x for pair in itertools.zip_longest(before, after) for x in pair if x is not None):
        if x != own and x not in out:
            out.append(x)
    return out


def _distinct(rows, own_host: str, k: int = REACH) -> list[list]:
    """The first k different contents of a host's run of (host, hashes)."""
    out: list[list] = []
    for host, hashes in rows:
        if host != own_host or len(out) == k:
            break
        if hashes not in out:
            out.append(hashes)
    return out


def _shared(beside: dict[int, tuple[list, list]]):
    """Sorted pages: the lines to delete of each page that has such lines.

    Pages wait until REACH + 1 other contents of their host have come, or the
    host ends; those of equal content wait as one with a list of their ids.
    """

    def run(batches):
        from pyspark import TaskContext

        before, after = beside.get(TaskContext.get().partitionId(), ([], []))
        past: list[tuple[str, list]] = list(reversed(before))  # nearest first
        held = 0  # lines of
        waiting: list[list] = []  # host, hashes, sizes, inside, [(page, fp)]

        def settle(k: int, beyond: list) -> tuple[list, list, list]:
            """The first k of the waiting pages."""
            nonlocal past
            ids, fps, gone = [], [], []
            for i in range(k):
                host, hashes, sizes, inside, pages = waiting[i]
                later = [(w[0], w[1]) for w in waiting[i + 1 :]] + beyond
                near = _near(_distinct(past, host, REACH + 1), _distinct(later, host, REACH + 1), hashes)[: 2 * REACH]
                if drop := deleted(hashes, sizes, inside, near):
                    for page, fp in pages:
                        ids.append(page)
                        fps.append(fp)
                        gone.append(drop)
                past = [(host, hashes), *[p for p in past if p[0] == host]][: 2 * REACH + 2]
            del waiting[:k]
            return ids, fps, gone

        def batch(ids, fps, gone):
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(fps, pa.int64()), pa.array(gone, pa.list_(pa.int32()))], names=["page_id", "fp", "gone"])

        for b in batches:
            for page, fp, host, _, hashes, sizes, inside in zip(*(c.to_pylist() for c in b.columns)):
                if waiting and waiting[-1][0] == host and waiting[-1][1] == hashes and waiting[-1][3] == inside:
                    waiting[-1][4].append((page, fp))
                    continue
                waiting.append([host, hashes, sizes, inside, [(page, fp)]])
                held += len(hashes)
                if len(waiting) > 4 * REACH + 4 and (len(waiting) >= 512 or held >= 200_000):
                    held = sum(len(w[1]) for w in waiting[-2 * REACH - 2 :])
                    found = settle(len(waiting) - 2 * REACH - 2, [])
                    if found[0]:
                        yield batch(*found)
        found = settle(len(waiting), after)
        if found[0]:
            yield batch(*found)

    return run


def shared_lines(pages: DataFrame) -> DataFrame:
    """page_id, fp, gone: the places of the lines that each page shares with its neighbours."""
    n = shuffle_partitions(pages.sparkSession)
    order = ["host", "path", "page_id", "fp"]
    keys = checkpointed(page_keys(pages).repartitionByRange(n, *order).sortWithinPartitions(*order))
    # at most 2 REACH pages of each partition, as hashes
    rows = sorted(keys.mapInArrow(_edges, "pid int, k bigint, host string, hashes array<bigint>").collect(), key=lambda r: (r.pid, r.k))
    beside, pids = {}, [r.pid for r in rows]
    for pid in set(pids):
        lo, hi = bisect.bisect_left(pids, pid), bisect.bisect_right(pids, pid)
        # those of other partitions, far enough that small partitions of one host don't hide their neighbours
        before = [(r.host, r.hashes) for r in rows[max(0, lo - 4 * REACH) : lo]]
        after = [(r.host, r.hashes) for r in rows[hi : hi + 4 * REACH]]
        beside[pid] = (before, after)
    return keys.mapInArrow(_shared(beside), "page_id bigint, fp bigint, gone array<int>")


def _texts(batches):
    for b in batches:
        out = []
        for source, gone in zip(b.column(2), b.column(3).to_pylist()):
            out.append(main_text(*candidates(source.as_py()), gone or []))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string())], names=["page_id", "url", "text"])


def html_text(pages: DataFrame, broadcast_rows: int = 50_000) -> DataFrame:
    """page_id, url, text and n_chars of every page.

    The pages with deleted lines are broadcast up to ``broadcast_rows`` of them
    (their number is counted), and joined by a shuffle beyond.
    """
    gone = checkpointed(shared_lines(pages).groupBy("page_id", "fp").agg(F.first("gone").alias("gone")))
    small = gone.count() <= broadcast_rows
    right = gone.select(F.coalesce("page_id", F.lit(NULL_ID)).alias("__id"), F.col("fp").alias("__fp"), "gone")
    left = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html", F.coalesce(F.col("page_id").cast("bigint"), F.lit(NULL_ID)).alias("__id"), _fp().alias("__fp"))
    both = left.join(F.broadcast(right) if small else right, ["__id", "__fp"], "left")
    return both.select("page_id", "url", "html", "gone").mapInArrow(_texts, "page_id bigint, url string, text string").withColumn("n_chars", F.length("text").cast("bigint"))
