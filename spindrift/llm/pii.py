"""Personal data by weak supervision (operator 1), in DataFrame functions only.

Four base kinds (email, ip, card, phone) are found by their patterns and always
stay. Besides them looser patterns propose candidates: numbers in national
form, short card numbers, spelt-out mail addresses, secrets, social security
numbers. On every candidate, base ones included, labellers vote yes, no or
nothing: a strict form, a gazetteer (top-level domains, issuer digits, area
codes, key words), the words around it, and a checksum or the shape of the
value. The votes are counted by pattern; expectation-maximisation over the
counts (at most kinds x 3^4 rows, on the driver) estimates how far each labeller
is to be trusted, and a logistic regression on the votes and the kind, trained
on the posterior labels, becomes the span classifier: one expression that
decides about each further candidate.

Offsets are code points, end exclusive. A null or empty text has no spans; a
very long one is searched whole, in time that grows little faster than its
number of spans. Candidates that touch a base span, or an earlier candidate
(by start, then end, then kind), are dropped. The statistics come from all rows;
repeated rows count again and get equal results. An empty table gives none.
Other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import let, scanned

# The published patterns with possessive repetition, which matches the same but
# neither recurses nor backtracks, and with a start that a match can have.
_LOCAL = "[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
EXTRA = {
    "email": rf"(?<!{_LOCAL}){_LOCAL}{{1,64}}(?:\x20?[\[(]at[\])]\x20?|\x20at\x20)[A-Za-z0-9-]{{1,64}}(?:\x20?[\[(]dot[\])]\x20?|\x20dot\x20|\.)[A-Za-z]{{2,12}}(?![A-Za-z])",
    "card": r"(?<![0-9+.-])[0-9](?:[\x20-]?[0-9]){12,14}(?![\x20-]?[0-9])",
    "phone": r"(?<![0-9+().-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    "secret": r"(?i:token|secret|passw(?:or)?d|api[_-]?key|access[_-]?key|auth)[\"']?\s{0,3}[:=]\s{0,3}[\"']?[A-Za-z0-9_/+-]{12,}+|AKIA[0-9A-Z]{16}(?![0-9A-Za-z])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
KINDS = ["email", "ip", "card", "phone", "secret", "ssn"]
LABELLERS = ["strict", "gazetteer", "context", "shape"]
_TLDS = "com|org|net|edu|gov|info|io|co|de|fr|es|uk|eu|us|it|nl|ch|at|pt|mx"
_CUES = {
    "email": "mail|contact|write|reach|address|correo|adresse",
    "ip": r"\bip\b|host|server|addr|ping|connect|login",
    "card": "card|visa|master|amex|credit|debit|pay|karte|carte|tarjeta",
    "phone": "tel|phone|call|fax|mobile|cell|whatsapp|ruf",
    "secret": "token|secret|pass|key|auth|config|export",
    "ssn": "ssn|social|security|insurance",
}
_NOT_CUES = r"version|isbn|issn|order|invoice|figure|fig\.|page|chapter|section|table|doi|rfc|build|#\s*$"
_LEAST = 0.5
_AROUND = 40


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def total(d: Column) -> Column:
        n = F.length(d)
        value = lambda k: F.substr(d, n - k, F.lit(1)).cast("int")
        twice = lambda x: F.when(x > 4, 2 * x - 9).otherwise(2 * x)
        return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda a, k: a + F.when(k % 2 == 1, twice(value(k))).otherwise(value(k)))

    return F.when(F.length(digits) > 0, let(digits, lambda d: total(d)) % 10 == 0).otherwise(F.lit(False))


def _valid_ip(m: Column) -> Column:
    part = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
    return m.rlike(rf"^{part}(?:\.{part}){{3}}$")


def _base_holds(kind: str, m: Column) -> Column:
    if kind == "ip":
        return _valid_ip(m)
    if kind == "card":
        return let(_digits(m), lambda d: F.length(d).between(16, 19) & F.when(F.length(d).between(16, 19), luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(_digits(m)).between(8, 15)
    return F.lit(True)


_SPAN = "struct<kind:string,start:int,end:int,value:string,left:string,right:string>"
_SORTED = "struct<start:int,end:int,kind:string,value:string,left:string,right:string>"


def find_spans(text: Column, kind: str, pattern: str, holds=None) -> Column:
    """The matches that hold (all without ``holds``) with their places and what stands around them.

    The others are dropped on the way: texts full of numbers have many of them.
    """
    parts = F.struct(F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)).alias("m"), F.split(text, pattern, -1).alias("g"))

    def place(p: Column) -> Column:
        around = lambda m, k: F.struct(
            m.alias("value"), F.length(p["g"][k]).alias("gap"), F.substr(p["g"][k], F.lit(-_AROUND), F.lit(_AROUND)).alias("left"), F.substr(p["g"][k + 1], F.lit(1), F.lit(_AROUND)).alias("right"),
        )

        def step(at: Column, x: Column) -> tuple[Column, Column]:
            start = at + x["gap"]
            end = start + F.length(x["value"])
            span = F.array(F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), x["value"].alias("value"), x["left"].alias("left"), x["right"].alias("right")))
            return end, span if holds is None else F.when(holds(x["value"]), span).otherwise(F.array().cast(f"array<{_SPAN}>"))

        return scanned(F.transform(p["m"], around), F.lit(0), _SPAN, step)

    return let(parts, place)


def touching(base: Column, size: int = 64):
    """A test whether a span touches one of the base spans: those sorted by start, in blocks, of which few are looked into."""
    places = F.sort_array(F.transform(base, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))

    def blocks(p: Column) -> Column:
        part = lambda b: let(
            F.slice(p, b * size + 1, F.lit(size)), lambda x: F.struct(x[0]["start"].alias("start"), F.array_max(F.transform(x, lambda s: s["end"])).alias("end"), x.alias("part"))
        )
        return F.when(F.size(p) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / size).cast("int")), part)).otherwise(F.array())

    meet = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])
    return let(places, blocks), lambda found, x: F.exists(found, lambda b: meet(b, x) & F.exists(b["part"], lambda s: meet(s, x)))


def _guard(text: Column, kind: str, extra: bool) -> Column:
    """What a text must hold for the pattern to be tried."""
    if kind == "email":
        return (text.contains(" at ") | text.contains("at)") | text.contains("at]")) if extra else text.contains("@")
    if kind == "phone" and not extra:
        return text.contains("+")
    if kind == "secret":
        return text.contains("=") | text.contains(":") | text.contains("AKIA")
    if kind == "ssn":
        return text.rlike("[0-9]-[0-9]")
    return text.rlike("[0-9]")


def spans_of(docs: DataFrame) -> DataFrame:
    """doc_id, base and extra: the base spans that hold, and the further candidates."""
    text = F.coalesce(F.col("text"), F.lit(""))
    none = F.array().cast(f"array<{_SPAN}>")

    def tried(kind: str, pattern: str, extra: bool) -> Column:
        holds = None if extra else lambda m: _base_holds(kind, m)
        return F.when(_guard(text, kind, extra), find_spans(text, kind, pattern, holds)).otherwise(none)

    base = F.concat(*[tried(k, p, False) for k, p in BASE.items()])
    extra = F.concat(*[tried(k, p, True) for k, p in EXTRA.items()])
    found = docs.select("doc_id", base.alias("base"), extra.alias("extra"))
    fields = _SORTED.removeprefix("struct<").removesuffix(">").split(",")
    sort = lambda s: F.sort_array(F.transform(s, lambda x: F.struct(*[x[f.split(":")[0]].alias(f.split(":")[0]) for f in fields])))
    free = lambda end, x: (F.greatest(end, F.when(x["start"] >= end, x["end"])), F.when(x["start"] >= end, F.array(x)).otherwise(F.array().cast(f"array<{_SORTED}>")))
    blocks, touches = touching(F.col("base"))
    alone = let(blocks, lambda b: F.filter("extra", lambda x: ~touches(b, x)))
    kept = F.when(F.size("extra") == 0, F.array().cast(f"array<{_SORTED}>")).otherwise(scanned(sort(alone), F.lit(0), _SORTED, free))
    return found.select("doc_id", "base", kept.alias("extra"))


def votes(span: Column) -> dict[str, Column]:
    """Each labeller's vote on a span: 1, 0 or null."""
    kind, value, left, right = span["kind"], span["value"], F.lower(span["left"]), F.lower(span["right"])
    digits = _digits(value)

    def by_kind(**cases: Column) -> Column:
        out = F.lit(None).cast("int")
        for k, c in cases.items():
            out = F.when(kind == k, c.cast("int")).otherwise(out)
        return out

    yes_no = lambda c: F.when(c, 1).otherwise(0)
    yes = lambda c: F.when(c, 1)
    cue = F.lit(False)
    for k, words in _CUES.items():
        cue = cue | ((kind == k) & left.rlike(words))
    return {
        "strict": by_kind(
            email=yes(value.rlike(r"^[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,12}$|[\[(]at[\])]")),
            ip=yes_no(_valid_ip(value) & ~right.rlike(r"^\.?[0-9]")),
            card=yes(value.rlike(r"^(?:[0-9]{13,19}|(?:[0-9]{4}[ -]){3}[0-9]{1,7}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})$")),
            phone=yes(value.rlike(r"^(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-][0-9]{3,4}[ .-][0-9]{3,4}$")),
            secret=yes_no(value.rlike(r"[=:]\s{0,3}[\"'][A-Za-z0-9_/+-]+$") & right.rlike("^[\"']")),
            ssn=yes_no(~value.rlike(r"^(?:000|666|9[0-9]{2})-|-00-|-0000$")),
        ),
        "gazetteer": by_kind(
            email=yes_no(F.lower(value).rlike(rf"(?:\.|dot[\])]?\s?)(?:{_TLDS})$")),
            ip=yes_no(~value.rlike(r"^(?:0+|22[4-9]|2[345][0-9])\.")),
            card=yes_no(digits.rlike("^(?:4|5[1-5]|2[2-7]|3[4-7]|6)")),
            phone=yes_no(value.startswith("+") | digits.rlike("^[2-9]")),
            secret=yes(value.rlike("(?i)token|secret|passw|key|AKIA")),
        ),
        "context": F.when(cue, 1).when(left.rlike(_NOT_CUES), 0).cast("int"),
        "shape": by_kind(
            email=yes_no(F.length(value).between(6, 80)),
            ip=yes_no(~value.rlike(r"^(?:[0-9]\.){3}[0-9]$")),
            card=yes_no(luhn(digits)),
            phone=yes_no(F.length(digits).between(8, 15)),
            secret=yes_no(value.rlike("[0-9][^0-9]*+[0-9]") & value.rlike("[a-zA-Z]")),
        ),
    }


class LabelModel:
    """One accuracy for each labeller and class, and a share of true spans for each kind."""

    def __init__(self, rows: list[tuple[str, tuple, int]], rounds: int = 100):
        """rows: kind, votes (None for none), how often."""
        n = len(LABELLERS)
        self.share = {k: 0.8 for k in KINDS}
        self.right = [[0.75] * n, [0.85] * n]
        for _ in range(rounds if rows else 0):
            hit, all_ = [[4.0] * n for _ in (0, 1)], [[5.0] * n for _ in (0, 1)]
            true, seen = dict.fromkeys(KINDS, 4.0), dict.fromkeys(KINDS, 5.0)
            for kind, vote, count in rows:
                p = self.posterior(kind, vote)
                true[kind] += p * count
                seen[kind] += count
                for j, v in enumerate(vote):
                    if v is not None:
                        for c, w in ((0, 1 - p), (1, p)):
                            all_[c][j] += w * count
                            hit[c][j] += w * count * (v == c)
            self.share = {k: min(0.98, max(0.02, true[k] / seen[k])) for k in KINDS}
            # a labeller is better than chance
            self.right = [[max(0.55, h / a) for h, a in zip(hit[c], all_[c])] for c in (0, 1)]

    def posterior(self, kind: str, vote: tuple) -> float:
        score = math.log(self.share[kind] / (1 - self.share[kind]))
        for j, v in enumerate(vote):
            if v == 1:
                score += math.log(self.right[1][j] / (1 - self.right[0][j]))
            elif v == 0:
                score += math.log((1 - self.right[1][j]) / self.right[0][j])
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, score))))


class SpanClassifier:
    """Logistic regression on votes and kinds; ``expression`` is its decision as a column."""

    def __init__(self, rows: list[tuple[str, tuple, int]], model: LabelModel, rounds: int = 400, l2: float = 1e-3):
        n = len(LABELLERS)
        self.vote = {(j, v): 0.0 for j in range(n) for v in (0, 1)}
        self.kind, self.bias = dict.fromkeys(KINDS, 0.0), 0.0
        total = sum(math.sqrt(c) for _, _, c in rows) or 1.0  # rare kinds count for more than their rows
        target = [model.posterior(k, v) for k, v, _ in rows]
        for _ in range(rounds):
            gv, gk, gb = dict.fromkeys(self.vote, 0.0), dict.fromkeys(KINDS, 0.0), 0.0
            for (kind, vote, count), y in zip(rows, target):
                e = (self.score(kind, vote) - y) * math.sqrt(count) / total
                gb += e
                gk[kind] += e
                for j, v in enumerate(vote):
                    if v is not None:
                        gv[j, v] += e
            self.bias -= 1.5 * gb
            for k in KINDS:
                self.kind[k] -= 1.5 * (gk[k] + l2 * self.kind[k])
            for k in self.vote:
                self.vote[k] -= 1.5 * (gv[k] + l2 * self.vote[k])

    def score(self, kind: str, vote: tuple) -> float:
        s = self.bias + self.kind[kind] + sum(self.vote[j, v] for j, v in enumerate(vote) if v is not None)
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, s))))

    def expression(self, span: Column) -> Column:
        s = F.lit(self.bias)
        for k, w in self.kind.items():
            s = s + F.when(span["kind"] == k, F.lit(w)).otherwise(0.0)
        for j, c in enumerate(votes(span).values()):
            s = s + F.when(c == 1, F.lit(self.vote[j, 1])).when(c == 0, F.lit(self.vote[j, 0])).otherwise(0.0)
        return 1 / (1 + F.exp(-s))


def vote_counts(found: DataFrame) -> list[tuple[str, tuple, int]]:
    """How often each pattern of votes occurs for each kind: at most 6 x 81 rows."""
    view = lambda c: F.transform(c, lambda s: F.struct(*[s[x].alias(x) for x in ("kind", "value", "left", "right")]))
    span = found.select(F.explode(F.concat(view("base"), view("extra"))).alias("s"))
    counted = span.select(F.col("s.kind").alias("kind"), *[c.alias(n) for n, c in votes(F.col("s")).items()]).groupBy("kind", *LABELLERS).count()
    return sorted(((r["kind"], tuple(r[n] for n in LABELLERS), r["count"]) for r in counted.collect()), key=repr)


def pii(docs: DataFrame) -> DataFrame:
    """doc_id, base and added (arrays of kind, start, end, value, score) for every document."""
    found = spans_of(docs)
    rows = vote_counts(found)
    classifier = SpanClassifier(rows, LabelModel(rows))
    scored = F.transform("extra", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), classifier.expression(s).alias("score")))
    base = F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), F.lit(1.0).alias("score")))
    return found.select("doc_id", base.alias("base"), F.filter(scored, lambda s: s["score"] >= _LEAST).alias("added"))


def digest(found: DataFrame) -> DataFrame:
    """The counts, the base spans' hash, all spans as strings, and how many were added."""
    rank = lambda s: F.array_position(F.array(*[F.lit(k) for k in KINDS]), s["kind"])
    sort = lambda c: F.sort_array(F.transform(c, lambda s: F.struct(rank(s).alias("r"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    text = lambda c: F.array_join(F.transform(sort(c), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    n = lambda c, k: F.size(F.filter(c, lambda s: s["kind"] == k)).cast("bigint")
    return found.select(
        "doc_id", *[n("base", k).alias(f"n_{k}") for k in BASE], F.sha2(text(F.col("base")), 256).alias("base_sha256"), text(F.concat("base", "added")).alias("spans"),
        n("added", "secret").alias("n_secret"), n("added", "ssn").alias("n_ssn"), F.size("added").cast("bigint").alias("n_added"), (F.size("base") + F.size("added")).cast("bigint").alias("n_spans"),
    )
