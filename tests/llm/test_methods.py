"""The methods against plain versions of themselves, and defined results in odd cases."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.llm import common
from spindrift.llm import decontaminate as D
from spindrift.llm import html_text as H
from spindrift.llm import jaccard_join as J
from spindrift.llm import language as L
from spindrift.llm import pii
from spindrift.llm import quality_classifier as Q
from spindrift.llm import toxicity as X

ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "½ ² Ⅷ 12"), (5, "the cat sat"), (5, "the cat sat"), (None, "der hund lief"), (6, "word " * 30_000)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id bigint, text string").withColumns({"lang": F.lit("xx"), "source": F.lit("s"), "h": F.lit(1), "k": F.lit("k"), "y": F.lit(2), "n": F.lit(3)})


# -- operator 3


def test_large_regions_lose_no_pair(spark):
    rows = spark.range(60).select(F.lit(7).alias("h"), F.col("id").alias("k"), F.lit(5).alias("n")).union(spark.range(3).select(F.lit(8), F.col("id") + 50, F.lit(5)))
    for block in (7, 1000):
        got = [(r.a, r.b) for r in J.region_pairs(rows, block).collect()]
        assert sorted(got) == sorted([(a, b) for b in range(60) for a in range(b)] + [(50, 51), (50, 52), (51, 52)])


def test_a_passage_that_many_documents_share_links_only_copies(spark):
    rng = random.Random(3)
    shared = " ".join(f"p{i}" for i in range(60))
    rows = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(40)) + " " + shared) for i in range(400)]
    rows += [(1000 + i, t + " more") for i, t in rows[:20]] + [(2000 + i, t) for i, t in rows[:5]] + [(3000, shared), (3001, shared + " x")]
    sets = [(i, {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)}) for i, t in rows]
    near = {i: {j for j, b in sets if j != i and 100 * len(a & b) >= 80 * len(a | b)} for i, a in sets}
    got = {r.doc_id: (r.n_similar, r.component_id) for r in J.jaccard_join(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {i: (len(near[i]), min(near[i] | {i})) for i in near}


# -- operator 4


class PlainTrees:
    """Prediction by partial matching with dictionaries, one byte at a time; contexts as the frozen model has them."""

    def __init__(self, texts, states, a, symbols):
        self.states, self.symbols = states, symbols
        self.counts = {}
        for t in texts:
            s = [0] * L.ORDER + [int(symbols[b]) for b in t.encode()]
            for i in range(L.ORDER, len(s)):
                for o in range(L.ORDER + 1):
                    d = self.counts.setdefault(tuple(s[i - o : i]), {})
                    d[s[i]] = d.get(s[i], 0) + 1

    def p(self, context, x):
        seen = self.counts.get(context, {}) if context in self.states else {}
        shorter = context[1:]
        back = 1 / 256 if not context else self.p(shorter, x)
        n, d = sum(seen.values()), len(seen)
        return seen[x] / (n + d) if x in seen else (d / (n + d) if n else 1.0) * back

    def bits(self, text):
        s, total = [0] * L.ORDER + [int(self.symbols[b]) for b in text.encode()], 0.0
        for i in range(L.ORDER, len(s)):
            context = tuple(s[i - L.ORDER : i])
            while context not in self.states:
                context = context[1:]
            total -= math.log2(self.p(context, s[i]))
        return total


def test_code_lengths_are_those_of_plain_trees():
    texts = {"en": ["the cat and the dog ran to the barn and sat there "] * 8, "de": ["der hund und die katze liefen in den stall und assen "] * 8}
    trees = L.train(texts, min_context=5)
    a = trees.n_symbols
    often = {()}
    for group in texts.values():
        count = {}
        for t in group:
            s = [0] * L.ORDER + [int(trees.symbols[b]) for b in t.encode()]
            for i in range(L.ORDER, len(s)):
                for o in range(1, L.ORDER + 1):
                    c = tuple(s[i - o : i])
                    count[c] = count.get(c, 0) + 1
        often |= {c for c, n in count.items() if n >= 5}
    for sample in ("the dog sat", "die katze und", "zebra xylophone", "the hund"):
        want = [PlainTrees(texts[g], often, a, trees.symbols).bits(sample) for g in trees.langs]
        assert np.allclose(trees.code_lengths(sample), want, rtol=1e-4), sample


def test_language_of_odd_rows(spark, odd):
    train = spark.createDataFrame([(100 + i, "the cat sat on the mat and ran", "en") for i in range(20)] + [(200 + i, "der hund lief in den wald und bellte", "de") for i in range(20)], "doc_id bigint, text string, lang string")
    docs = train.unionByName(odd.select("doc_id", "text").withColumn("lang", F.lit(None).cast("string")))
    got = sorted((str(r.doc_id), r.lang_pred) for r in L.language_id(docs).filter("doc_id IS NULL OR doc_id < 100").collect())
    assert [x for x in got if x[0] != "6"] == [("1", "und"), ("2", "und"), ("3", "und"), ("4", "und"), ("5", "en"), ("5", "en"), ("None", "de")]
    assert all(r.lang_pred == "und" and r.score == 0 for r in L.language_id(docs.withColumn("lang", F.lit(None).cast("string"))).limit(3).collect())
    assert L.language_id(docs.filter("false")).count() == 0
    with pytest.raises(ValueError):
        L.identify(docs.withColumn("score", F.lit(1)), L.train({"en": ["a"]}))


# -- operator 5


def longest(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


@pytest.mark.parametrize("cells", [4_000_000, 12])
def test_alignments_are_longest(monkeypatch, cells):
    monkeypatch.setattr(H, "CELLS", cells)
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(25))] for _ in "ab")
        found = sorted(H.common_lines(a, b))
        rest = iter(b)
        assert len(found) == longest(a, b) and all(a[i] in rest for i in found)


PAGES = {
    "<article><h1>T</h1><section id='search-algorithms'><h2>Search</h2><p>Halve it.</p></section><div class='legal history'><p>Law.</p></div><h2 id='related-work'>Related</h2><div class='ad-slot'>Buy</div><div class='comments'><p>nice</p></div></article>": "T\nSearch\nHalve it.\nLaw.\nRelated",
    "<article class='card'>Teaser</article><div id='content'><p>The long and real text of the page is here.</p></div>": "The long and real text of the page is here.",
    "<main><article><h1>A</h1><p>" + "long " * 30 + "</p><article><p>first!</p></article></article><section><h3>3 Comments</h3><p>me too</p></section></main>": "A\n" + ("long " * 30).strip(),
    "<p>Plain</p><div class='search'><a href='/'>all of these</a></div><div class='search'>We search for words.</div>": "Plain\nWe search for words.",
    "<p>a &lt;b&gt; &amp; c<script>x</script><style>y</style><form>f</form>": "a <b> & c",
    "": "",
}


@pytest.mark.parametrize("source", PAGES)
def test_markup(source):
    assert H.main_text(*H.candidates(source), []) == PAGES[source]


def test_differencing_decides_inside_articles_too(spark):
    page = lambda k, own: f"<body><article><p>Site notice for all readers of this place</p><h1>Story {k}</h1><p>{own}</p><p>Follow us wherever you are</p></article></body>"
    story = lambda k: f"Story number {k} tells of things that happened only once, in a town called place{k}."
    rows = [(k, f"http://h.example/{k:03d}", page(k, story(k))) for k in range(30)]
    rows += [(100 + k, "http://h.example/005", page(5, story(5))) for k in range(20)]  # equal pages stand for one
    long = story(1) + "</p><p>It went on like this for quite a while, and nobody ever wrote it down."
    rows += [(200, "http://lone/1", page(1, long + "</p><p>The end.")), (201, "http://lone/2", page(1, long + "</p><p>Edited."))]
    rows += [(300, None, None), (301, None, ""), (302, "http://h.example/long", "<p>Site notice for all readers of this place</p>" + "".join(f"<p>line {i % 7000}</p>" for i in range(8000)))]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumns({"text": F.lit("clash"), "fp": F.lit(1), "gone": F.lit(2)})
    for n in (1, 5):
        out = {r.page_id: r for r in H.html_text(df.repartition(n)).collect()}
        for k in range(30):
            assert out[k].text == f"Story {k}\n{story(k)}", k
        assert all(out[100 + k].text == out[5].text for k in range(20))
        # an edited copy says nothing about its host
        assert out[200].text.startswith("Site notice") and story(1) in out[200].text and "Edited." in out[201].text
        assert out[300].text == out[301].text == "" and out[302].n_chars == len(out[302].text) > 60_000
    assert H.html_text(df.filter("false")).count() == 0


# -- operator 6


def test_label_model_is_plain_em():
    rng = np.random.default_rng(4)
    truth = rng.random(400) < 0.7
    votes = np.where(rng.random((400, 4)) < 0.3, -1, np.where(rng.random((400, 4)) < 0.85, truth[:, None], ~truth[:, None]).astype(int))
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = Q.LabelModel(patterns, counts.astype(float), rounds=20)
    prior, right = 0.75, [[0.8] * 4, [0.8] * 4]

    def posterior(row):
        odds = prior / (1 - prior)
        for j, v in enumerate(row):
            if v == 1:
                odds *= right[1][j] / (1 - right[0][j])
            elif v == 0:
                odds *= (1 - right[1][j]) / right[0][j]
        return odds / (1 + odds)

    for _ in range(20):
        p = [posterior(r) for r in votes]
        prior = min(0.98, max(0.02, sum(p) / len(p)))
        right = [[max(0.6, (8 + sum(w for w, r in zip(ws, votes) if r[j] == c)) / (10 + sum(w for w, r in zip(ws, votes) if r[j] >= 0))) for j in range(4)] for c, ws in ((0, [1 - x for x in p]), (1, p))]
    assert np.allclose(model.posterior(votes), [posterior(r) for r in votes], atol=1e-6) and ((model.posterior(votes) > 0.5) == truth).mean() > 0.9


def test_quality_of_prose_and_junk(spark, odd):
    prose = "The people of the town went to the market in the morning, and they bought what they needed for the week. It was a good day. "
    junk = "$$$ BUY### NOW&&& !!! ||| CLICK$$$ HERE### WIN%%% *** @@@ "
    rows = [(1000 + i, prose * 3 + f"Day {i}.") for i in range(40)] + [(2000 + i, junk * 4 + str(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").unionByName(odd.select("doc_id", "text"))
    out = Q.quality_classifier(df).collect()
    assert len(out) == len(rows) + len(ODD)
    assert all(r.kept for r in out if r.doc_id and 1000 <= r.doc_id < 2000) and not any(r.kept for r in out if r.doc_id and r.doc_id >= 2000)
    twins = [r.score for r in out if r.doc_id == 5]
    assert len(set(twins)) == 1


def test_samples_take_the_least_hashes(spark):
    rows = spark.range(500).select((F.col("id") % 300).alias("doc_id"))
    want = {r.doc_id for r in rows.distinct().orderBy(F.xxhash64("doc_id")).limit(40).collect()}
    for among in (None, 500, 20_000):  # a count that is far off costs another round, no more
        assert {r.doc_id for r in common.least_ids(rows, 40, among).collect()} == want
    texts = spark.createDataFrame([(1, "b"), (1, "a"), (2, None), (3, "x" * 50), (4, "")], "doc_id bigint, text string")
    got = common.sample_texts(texts, spark.range(5).select(F.col("id").alias("doc_id")), 20)
    assert [(r.doc_id, r.text) for r in got] == [(1, "a"), (4, "")]


# -- operator 7


def test_toxicity_is_plain_regression_on_log_count_ratios():
    rng = random.Random(2)
    words = "you are a total kind moron friend idiot of the house today".split()
    texts = [" ".join(rng.choice(words[:4] + [w] + words[8:]) for w in [rng.choice(["kind", "friend"] if y == 0 else ["moron", "idiot"])] * 6) + (" friend" if y == 0 else " idiot") for y in (0, 1) * 60]
    labels = [0, 1] * 60
    model = X.fit(texts, labels, sizes=(4,), bits=16, min_z=4.5)
    sets = [set(X.ngram_buckets(t, (4,), 16).tolist()) for t in texts]
    n1, n0 = sum(labels), len(labels) - sum(labels)
    ratio = {}
    for b in set().union(*sets):
        p, q = (sum(b in s for s, y in zip(sets, labels) if y == v) for v in (1, 0))
        share = (p + q) / len(labels)
        z = (p / n1 - q / n0) / math.sqrt(max(share * (1 - share), 1e-9) * (1 / n1 + 1 / n0))
        if abs(z) >= 4.5:
            ratio[b] = math.log((p + 0.5) / (n1 + 1)) - math.log((q + 0.5) / (n0 + 1))
    assert set(model.at.tolist()) <= set(ratio) and any(r < 0 for r in ratio.values()) and any(r > 0 for r in ratio.values())
    # the gradient of the penalised loss is nearly nought at the model's weights
    w = {b: v / ratio[b] for b, v in zip(model.at.tolist(), model.values)}
    score = [1 / (1 + math.exp(-(model.bias + sum(w.get(b, 0) * ratio[b] for b in s if b in ratio)))) for s in sets]
    for b in ratio:
        g = sum((p - y) * (0.5 / n1 if y else 0.5 / n0) * ratio[b] for p, y, s in zip(score, labels, sets) if b in s) + 0.3 / len(labels) * w.get(b, 0)
        assert abs(g) < 0.02
    table = model.table()
    assert all(abs(model.score(t, table) - p) < 1e-9 for t, p in zip(texts, score))


def test_toxicity_of_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 0), (2, 1), (5, 1), (5, 0), (None, 1), (6, None), (99, 1)], "doc_id bigint, toxic int")
    out = X.toxicity(odd, labels).collect()
    assert len(out) == len(ODD) and len({r.score for r in out if r.doc_id == 5}) == 1
    none = X.toxicity(odd, labels.filter("false")).collect()
    assert {(r.score, r.predicted) for r in none} == {(0.5, 1)} or len({r.score for r in none}) == 1
    with pytest.raises(ValueError):
        X.score(odd.withColumn("score", F.lit(1)), X.fit([], []))
    kept = X.score(odd.withColumn("score", F.lit(7)), X.fit([], []), names=("s", "p"))
    assert {r.score for r in kept.collect()} == {7}


# -- operator 10


def distance(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


@pytest.mark.parametrize("hits", [1_000_000, 50])
def test_items_are_found_as_full_alignment_finds_them(monkeypatch, hits):
    monkeypatch.setattr(D, "HITS", hits)  # few, so that the halving and the counting-free search run too
    rng = random.Random(hits)
    for t in range(40):
        letters = "ab" if t % 3 == 0 else "abcdefgh "
        items = [(i, "".join(rng.choice(letters) for _ in range(rng.randint(30, 70)))) for i in range(4)]
        doc = "".join(rng.choice(letters) for _ in range(200))
        for _, x in items:
            y = list(x)
            for _ in range(rng.randint(0, 6)):
                p = rng.randrange(len(y))
                y[p : p + 1] = rng.choice([[], [rng.choice(letters)], [y[p], rng.choice(letters)]])
            k = rng.randrange(len(doc))
            doc = doc[:k] + "".join(y) + doc[k:]
        plain = {i: D.normalise(x) for i, x in items}
        want = {i: d for i, x in plain.items() if len(x) >= D.MIN_CHARS and (d := distance(x, D.normalise(doc))) <= D.budget(len(x))}
        assert {i: d for i, _, d in D.Index(items).find(doc) if len(plain[i]) >= D.MIN_CHARS} == want


def test_hot_phrases_stay_within_memory():
    items = [(i, f"which of the following statements about the subject named below is true number {i}") for i in range(500)]
    index = D.Index(items)
    doc = "which of the following statements about the subject named below " * 400 + items[7][1]
    assert (7, 0) in {(i, d) for i, _, d in index.find(doc)}
    assert D.Index([(1, "a" * 500)]).find("a" * 4000)[0][2] == 0 and D.Index([(1, "a" * 250 + "b" * 250)]).find("a" * 4000) == []


def test_contamination_of_odd_rows_and_blocks(spark, odd):
    item = "The quick brown fox jumps over the lazy dog while seven wizards watch from the old stone bridge."
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, item + " And then some more of it followed.")], "item_id bigint, text string")
    docs = odd.unionByName(odd.filter("doc_id = 6").withColumns({"doc_id": F.lit(9).cast("bigint"), "text": F.concat("text", F.lit(item), "text")})).withColumns({"hits": F.lit(5), "_hits": F.lit("mine")})
    one, many = ({(str(r.doc_id), tuple(h.item_id for h in r.found)) for r in D.contamination(docs, bench, block_chars=b, name="found").collect()} for b in (4_000_000, 60))
    assert one == many and ("9", (1,)) in one and sum(1 for _, h in one if h) == 1
    kept = D.decontaminate(docs, bench)
    assert kept.columns == docs.columns and {(r.hits, r["_hits"]) for r in kept.collect()} == {(5, "mine")} and kept.count() == len(ODD)


# -- operator 1


def test_many_spans_in_one_text(spark):
    n = 700
    text = " ".join(f"user{i}@example{i}.com call 555-123-{1000 + i} or 10.0.{i % 256}.1 token=abcdef{i}0123456789xyz" for i in range(n))
    r = pii.digest(pii.pii(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id bigint, text string"))).orderBy("doc_id").collect()
    assert (r[0].n_email, r[0].n_ip, r[0].n_spans) == (n, n, r[0].n_added + 2 * n + r[0].n_phone + r[0].n_card) and (r[1].n_spans, r[2].n_spans) == (0, 0)
    spans = sorted((int(a), int(b), k) for k, a, b in (s.split(":") for s in r[0].spans.split(",")))
    assert all(text[a:b].startswith("user") for a, b, k in spans if k == "email") and sum(k == "phone" for _, _, k in spans) == n
    added = [(a, b) for a, b, k in spans if k in ("phone", "secret")]
    assert all(x[1] <= y[0] for x, y in zip(added, added[1:]))


def test_scanned_is_a_fold(spark):
    df = spark.createDataFrame([(list(range(n)),) for n in (0, 1, 63, 64, 65, 300)], "xs array<int>")
    step = lambda s, x: (s + x, F.when(x % 3 == 0, F.array(s + x)).otherwise(F.array().cast("array<int>")))
    for r in df.select("xs", common.scanned(F.col("xs"), F.lit(0), "int", step).alias("out")).collect():
        assert r.out == [sum(r.xs[: i + 1]) for i in range(len(r.xs)) if i % 3 == 0]
