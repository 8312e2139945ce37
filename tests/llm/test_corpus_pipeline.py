"""Stages of the corpus pipeline, compared with brute force."""

import random
import re
from collections import Counter

import corpus_pipeline as P
from spindrift.llm import decontaminate as D
from spindrift.llm import packing
from spindrift.llm import toxicity as X


def shingles(text):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def one_of_each(rows):
    """Which (doc_id, text) stay: one row of each component."""
    rows = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    sets, group = [shingles(t) for _, t in rows], list(range(len(rows)))
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if x and y and len(x & y) >= 0.8 * len(x | y):
                group = [group[j] if g == group[i] else g for g in group]
    seen, kept = set(), []
    for r, g in zip(rows, group):
        if g not in seen:
            kept.append(r)
        seen.add(g)
    return Counter(kept)


def test_near_copies_with_repeated_and_null_ids(spark):
    text = lambda c: " ".join(f"{c}{i}" for i in range(60))
    rows = [(1, text("a")), (1, text("a")), (2, text("a") + " more"), (3, text("b")), (3, text("a") + " again"), (4, text("b")), (5, ""), (6, ""), (7, None), (8, "short one")]
    rows += [(None, text("c"))] * 4 + [(None, text("d")), (None, text("b")), (9, text("e")), (9, text("f")), (9, "short one")]
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id bigint, text string, lang string")
    out = P.drop_near_copies(spark, docs, "")
    assert out.columns == docs.columns
    got = Counter((r.doc_id, r.text) for r in out.collect())
    assert got == one_of_each(rows)
    shuffled = P.drop_near_copies(spark, docs, "", broadcast_rows=0)
    assert Counter((r.doc_id, r.text) for r in shuffled.collect()) == got


def line_key(line):
    return re.sub(r"^[\x20\x09-\x0d]+|[\x20\x09-\x0d]+$", "", line).translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def without_repeated_lines(rows):
    low = lambda i: -(2**63) if i is None else i
    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(line_key(line)) >= 10:
                holders.setdefault(line_key(line), set()).add(low(i))
    keep = lambda i, line: not (len(line_key(line)) >= 10 and len(holders[line_key(line)]) > 1 and low(i) != min(holders[line_key(line)]))
    return [(i, "\n".join(x for x in (t or "").split("\n") if keep(i, x))) for i, t in rows]


def edits(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def leaked(text, items):
    t = D.normalise(text)
    return any(len(x) >= D.MIN_CHARS and edits(x, t) <= D.budget(len(x)) for x in map(D.normalise, items))


def test_all_stages(spark, tmp_path):
    rng = random.Random(5)
    words = [f"{a}{b}" for a in "bcdfglmnprst" for b in ("ala", "ero", "ino", "uto")]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    item = "The quick brown fox jumps over the lazy dog while seven wizards watch from the bridge."
    shared = "This very line stands in many of the documents here"
    rows = [(i, text(30) + ("\n" + shared if i % 4 == 0 else "") + "\n" + text(25)) for i in range(40)]
    rows += [(100 + i, f"{text(20)} you horrible filthy moron idiot {text(10)}") for i in range(30)]
    rows += [(200, text(10) + "\n" + item.replace("fox", "fix") + "\n" + text(5)), (201, item[:40]), (202, None), (203, ""), (204, "tiny"), (204, "tiny"), (None, text(40)), (None, text(12))]
    rows += [(300 + i, t.replace("\n", " ") + " more") for i, t in rows[1:6]] + [(310 + i, "\n" + t.replace("\n", "  ")) for i, t in rows[1:4]]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, "c", 0.5) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, hits int, row string, score double")
    labels = [(i, int(i >= 100)) for i, _ in rows[:70]]
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, "tiny")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    model = X.fit(*X.training_sample(docs, spark.createDataFrame(labels, "doc_id bigint, toxic int")))
    table = model.table()
    want = [(i, t) for i, t in rows if model.score(t, table) < 0.5]
    assert {i for i, _ in rows} - {i for i, _ in want} == set(range(100, 130))
    seen = {}
    at = docs
    for name, stage in P.STAGES[:-1]:
        at = stage(spark, at, str(tmp_path))
        at.write.parquet(f"{tmp_path}/{name}")
        at = spark.read.parquet(f"{tmp_path}/{name}")
        assert at.columns == docs.columns and {(r.hits, r.row, r.score, r.lang) for r in at.collect()} == {(1, "c", 0.5, "en")}
        seen[name] = Counter((r.doc_id, r.text) for r in at.collect())
    assert seen["toxicity"] == Counter(want)
    want = without_repeated_lines(want)
    assert {(i, t or "") for i, t in seen["line_dedup"]} == set(want)
    left = one_of_each(want)
    assert Counter({(i, t or ""): n for (i, t), n in seen["ngram_jaccard_join"].items()}) == left
    clean = {(i, t): n for (i, t), n in left.items() if not leaked(t, [item]) and not re.search(r"\btiny\b", t)}
    assert {(i, t or ""): n for (i, t), n in seen["benchmark_decontamination"].items()} == clean
    from tokenizers import Tokenizer

    tokens = Tokenizer.from_file(packing.vocabulary_path())
    pieces = P.run(spark, str(tmp_path)).collect()
    size = Counter()
    for r in pieces:
        size[r.doc_id] += r.length
    expect = Counter()
    for i, t in clean:
        expect[i] += len(tokens.encode(t, add_special_tokens=False).ids) + 1
    assert size == expect and len({(r.sequence_id, r.offset) for r in pieces}) == len(pieces)
    # an empty table goes through
    for name in ("documents", "labels"):
        spark.read.parquet(f"{tmp_path}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/none/{name}.parquet")
    spark.read.parquet(f"{tmp_path}/benchmark.parquet").write.parquet(f"{tmp_path}/none/benchmark.parquet")
    assert P.run(spark, f"{tmp_path}/none").count() == 0
