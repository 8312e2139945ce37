"""The corpus operators against brute-force versions, and their edge cases."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.llm import decontaminate as D
from spindrift.llm import html_text as H
from spindrift.llm import jaccard_join as J
from spindrift.llm import language as L
from spindrift.llm import line_dedup as LD
from spindrift.llm import packing as P
from spindrift.llm import pii
from spindrift.llm import quality_classifier as Q
from spindrift.llm import quality_rules as R
from spindrift.llm import toxicity as X

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
LONG = " ".join(WORDS[i % 20] + str(i % 97) for i in range(30_000))
TEXTS = [
    (1, "One shared line of text\nonly here\nOne shared line of text"),
    (2, "  ONE SHARED LINE OF TEXT\t\nAnother line that is alone"),
    (3, None),
    (4, ""),
    (5, " ".join(WORDS)),
    (6, " ".join(WORDS) + " omega"),
    (7, " ".join(WORDS[::-1])),
    (8, LONG),
    (9, "short"),
    (10, "short"),
    (None, "One shared line of text"),
    (11, "\n\n \n"),
    (11, "\n\n \n"),
    (12, "Éa ÄB mixed ÉTÉ Case line"),
    (13, "éa äb mixed ÉTÉ case line\nÉa Äb mixed ÉTÉ case line"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(TEXTS, "doc_id bigint, text string").withColumns({"n": F.lit(1), "k": F.lit("clash"), "score": F.lit(0), "hits": F.lit(0), "h": F.lit(None).cast("int")})


@pytest.fixture(scope="module")
def empty(docs):
    return docs.filter("false")


def key(line):
    return re.sub(r"^[\x20\x09-\x0d]+|[\x20\x09-\x0d]+$", "", line).translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def test_line_dedup(docs, empty):
    holders = {}
    low = lambda i: -(2**63) if i is None else i
    for i, t in TEXTS:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 10:
                holders.setdefault(key(line), set()).add(low(i))
    expect = []
    for i, t in TEXTS:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= 10 and len(holders[key(x)]) > 1 and low(i) != min(holders[key(x)]))]
        expect.append((str(i), len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    out = LD.apply_bitmaps(docs, LD.line_dedup(docs), digest=True)
    assert sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.kept_sha256) for r in out.collect()) == sorted(expect)
    assert LD.apply_bitmaps(empty, LD.line_dedup(empty)).count() == 0
    assert LD.apply_bitmaps(docs, LD.line_dedup(docs)).columns == docs.columns


def test_bitmap():
    assert LD.decode_bitmap(11, LD.encode_bitmap(11, [0, 7, 10])).tolist() == [i not in (0, 7, 10) for i in range(11)]


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0d]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_join(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    n = len(sets)
    link = lambda a, b: a and b and 100 * len(a & b) >= 80 * len(a | b)
    near = [[j for j in range(n) if j != i and link(sets[i][1], sets[j][1])] for i in range(n)]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [sets[j][0] for j in seen]
        out.append((str(sets[i][0]), len(sets[i][1]), len(near[i]), "None" if None in ids else str(min(ids))))
    return sorted(out)


def test_jaccard(spark, docs, empty):
    got = [(str(r.doc_id), r.n_shingles, r.n_similar, str(r.component_id)) for r in J.jaccard_join(docs).collect()]
    assert sorted(got) == brute_join(TEXTS)
    assert J.jaccard_join(empty).count() == 0
    # chains of near copies, many sharing one passage
    rng = np.random.default_rng(5)
    shared = " ".join(f"p{i}" for i in range(40))
    rows = []
    for g in range(6):
        w = [f"w{x}" for x in rng.integers(0, 5000, 160)]
        for k in range(6):
            w = list(w)
            w[int(rng.integers(0, 160))] = f"e{g}{k}"
            rows.append((len(rows) + 1, " ".join(w) + (" " + shared if k % 2 else "")))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted((str(r.doc_id), r.n_shingles, r.n_similar, str(r.component_id)) for r in J.jaccard_join(df).collect()) == brute_join(rows)


def brute_repeats(w):
    at = {}
    for i in range(len(w) - 4):
        at.setdefault(tuple(w[i : i + 5]), []).append(i)
    return len({i + k for v in at.values() if len(v) > 1 for i in v for k in range(5)})


def test_quality_rules(spark, docs, empty):
    rows = [*TEXTS, (20, "a b c d e f g a b c d e f x"), (21, "a a a a a a a"), (22, "x # y\nx # y\n \n z|")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    expect = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0d]+", t or "")
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
        rep = brute_repeats(w)
        expect.append((str(i), len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), rep, len(w) < 10 or 100 * rep > 20 * len(w)))
    got = [(str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in R.quality_rules(df).collect()]
    assert sorted(got) == sorted(expect)
    assert R.quality_rules(docs).filter("kept AND base_failed").count() == 0 and R.quality_rules(empty).count() == 0


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.vocabulary_path())
    encode = P.load_encoder(P.vocabulary_path())
    for s in [x for _, x in TEXTS if x] + ["a <|endoftext|> b", "  two  spaces\n\n tabs\t", "naïve 日本語 👍🏽 ½ x²", "\x00\x1f​"]:
        assert encode(s) == t.encode(s, add_special_tokens=False).ids
    rows = P.pack(P.token_pieces(docs, with_ids=True)).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.length == len(r.ids) <= 2048
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for i, s in TEXTS:
        if i != 11:  # that one is there twice
            ids = [x for r in sorted(by_doc[i], key=lambda r: r.piece) for x in r.ids]
            assert ids == t.encode(s or "", add_special_tokens=False).ids + [0]
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert P.pack(P.token_pieces(empty)).count() == 0


def test_sum_of_squares():
    rng = np.random.default_rng(1)
    sizes = np.sort(rng.integers(1, 2049, 3000))[::-1]
    p = P.SumOfSquares()
    for s in sizes:
        p.place(int(s))
    assert p.bins <= 1.06 * sizes.sum() / 2048 + 1


BASE = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(d):
    digits = [int(c) for c in reversed(d)]
    return sum(digits[::2] + [sum(divmod(2 * x, 10)) for x in digits[1::2]]) % 10 == 0


def brute_spans(t):
    out = []
    for kind, pattern in BASE:
        for m in re.finditer(pattern, t or ""):
            d = re.sub("[^0-9]", "", m.group())
            if kind == "email" or (kind == "ip" and all(int(x) <= 255 for x in m.group().split("."))) or (kind == "card" and 16 <= len(d) <= 19 and luhn(d)) or (kind == "phone" and 8 <= len(d) <= 15):
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def test_pii(spark, docs, empty):
    texts = ["a@b.c_x@y.z é👍 q@w.e.r.", "1.2.3.4.5.6.7.8 300.1.1.1 1.2.3 0001.2.3.4", "4111 1111 1111 1111 and 4111-1111-1111-1112", "+1 (017) 555-7713 +12 +1234567890123456", "7" * 20_000, "x" * 50_000 + "@", 'token = "908038b7daaf91e730d2"', "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").unionByName(docs.select("doc_id", "text"))
    out = pii.digest(pii.pii(df)).collect()
    got = sorted((str(r.doc_id), r.base_sha256) for r in out)
    assert got == sorted((str(i), hashlib.sha256(brute_spans(t).encode()).hexdigest()) for i, t in [*enumerate(texts), *TEXTS])
    assert any("secret:" in r.spans for r in out)
    assert pii.digest(pii.pii(empty)).count() == 0


def test_language():
    trees = L.train({"en": ["the cat and the dog " * 80], "de": ["der hund und die katze " * 80]}, min_context=2)
    assert L.predict("the dog", trees)[0] == "en" and L.predict("die katze und der hund", trees)[0] == "de"
    assert L.predict(None, trees) == ("und", 0.0) and L.predict("12 !?", trees) == ("und", 0.0)
    # a code length is the sum over bytes of their cost in context, whatever the blocks
    text = "the dog und die katze " * 50
    whole = trees.code_lengths(text)
    old, L.BLOCK = L.BLOCK, 7
    try:
        assert np.allclose(trees.code_lengths(text), whole)
    finally:
        L.BLOCK = old
    # each context's probabilities are at most one in all
    p = np.exp2(-trees.bits.reshape(-1, trees.n_symbols, 2)[:, 2:].astype(float)).sum(1)
    assert (p <= 1 + 1e-6).all()


def test_toxicity(spark, docs, empty):
    good = [f"you total friend of note number {i}" for i in range(60)]
    bad = [f"you total moron of note number {i}" for i in range(60)]
    m = X.fit(good + bad, [0] * 60 + [1] * 60)
    t = m.table()
    assert m.score("you total moron of note 99", t) > 0.5 > m.score("you total friend of note 99", t)
    assert m.score("what a moron he is", t) > m.score("what a friend he is", t)
    assert m.score(None, t) == m.score("", t) < 0.5
    labels = spark.createDataFrame([(1, 0), (2, 1), (99, 1), (None, 1), (5, None)], "doc_id bigint, toxic int")
    assert X.toxicity(docs, labels).count() == len(TEXTS) and X.toxicity(empty, labels.filter("false")).count() == 0


def test_decontamination(spark, docs, empty):
    item = "The quick brown fox jumps over the lazy dog while seven wizards watch from the old stone bridge."
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "tiny")], "item_id bigint, text string")
    index = D.Index([(1, item)])
    norm = D.normalise(item)
    for edit in (norm, norm.replace("fox", "fix"), norm.replace("seven ", ""), norm.replace("watch", "watch on"), item.upper().replace(" ", "\n")):
        hits = index.find("before it " + edit + " and after")
        assert [h[0] for h in hits] == [1] and hits[0][2] <= D.budget(len(norm))
    assert index.find(norm[: len(norm) // 2]) == [] and index.find(" ".join(reversed(norm.split()))) == []
    rows = docs.unionByName(docs.filter("doc_id = 8").withColumns({"doc_id": F.lit(77).cast("bigint"), "text": F.concat("text", F.lit(" " + item))}))
    found = {r.doc_id for r in D.contamination(rows, bench).filter("size(hits) > 0").collect()}
    assert found == {77} and D.decontaminate(empty, bench).count() == 0 and D.decontaminate(docs, bench.filter("false")).count() == len(TEXTS)


def test_html(spark):
    page = "<html><head><title>T</title></head><body><nav><a>Home</a></nav><div class='ad'>Buy</div><article><h1>A &amp; B</h1><p>One\n two<b> three<p>Four</article><section class='comments'><p>Nice</p></section><footer>F</footer>"
    assert H.candidates(page)[0] == ["A & B", "One two three", "Four"]
    plain = lambda k: f"<body><p>Site name</p><p>Story {k} goes on and on here</p><p>All rights</p></body>"
    rows = [(k, f"http://h.example/{k}", plain(k)) for k in range(5)] + [(9, None, None), (10, "http://x/", ""), (11, "http://c/1", plain(1)), (12, "http://c/2", plain(1))]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    out = {r.page_id: r.text for r in H.html_text(df).collect()}
    assert all(out[k] == f"Story {k} goes on and on here" for k in range(5)) and out[9] == out[10] == ""
    assert out[11] == "Site name\nStory 1 goes on and on here\nAll rights"  # a copy says nothing about the site
    assert H.html_text(df.filter("false")).count() == 0


def test_quality_classifier(docs, empty):
    out = Q.quality_classifier(docs).collect()
    assert len(out) == len(TEXTS) and all(0 <= r.score <= 1 for r in out)
    assert Q.quality_classifier(empty).count() == 0
