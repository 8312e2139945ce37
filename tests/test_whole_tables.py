"""Queries over whole tables, compared with brute force on small fixtures."""

import hashlib

import numpy as np

from spindrift import queries as Q


def write(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")


def documents(spark, folder, texts):
    write(spark, folder, "documents", [(i, t, "en", "web", len(t)) for i, t in texts.items()], "doc_id bigint, text string, lang string, source string, n_chars bigint")


def test_top_k_between_searches_every_vector(spark, tmp_path):
    vec = np.random.default_rng(1).normal(size=(40, 8)).astype(np.float32)
    vec /= np.linalg.norm(vec, axis=1, keepdims=True)
    documents(spark, tmp_path, {i: f"text {i}" for i in range(45)})
    write(spark, tmp_path, "embeddings", [(i, v.tolist()) for i, v in enumerate(vec)], "vec_id bigint, embedding array<float>")
    got = {(r.a, r.rank): (r.b, r.score) for r in Q.top_k_between(spark, str(tmp_path)).collect()}
    want = {(a, None): (None, None) for a in range(40, 45)}
    for a in range(40):
        s = vec.astype(np.float64) @ vec[a].astype(np.float64)
        want |= {(a, k): (b, round(s[b], 6)) for k, b in enumerate(np.argsort(-s)[:5].tolist(), 1) if s[b] >= 0.1}
    assert {k: b for k, (b, _) in got.items()} == {k: b for k, (b, _) in want.items()}
    assert all(abs(got[k][1] - s) < 2e-6 for k, (_, s) in want.items() if s is not None)


MIXED = {0: "plain ascii text of some length", 1: "abéééééé and more é", 2: "é", 3: "", 4: "😀\nfn 😀 x\nß", 5: "€" * 300 + "\n😀" + "z" * 500, 6: None}


def test_strip_ranges_cuts_bytes_of_every_text(spark, tmp_path):
    documents(spark, tmp_path, {k: v or "" for k, v in MIXED.items()})
    kept = lambda t: hashlib.sha256((t.encode()[:2] + t.encode()[9:]).decode("utf-8", "replace").encode()).hexdigest()
    assert {r.unit_ix: r.kept for r in Q.strip_ranges(spark, str(tmp_path)).collect()} == {k: kept(v or "") for k, v in MIXED.items()}


def position(text, byte):
    head, n = "", 0
    for c in text:
        if n >= byte:
            break
        head, n = head + c, n + len(c.encode())
    return head.count("\n"), len(head.rpartition("\n")[2].encode("utf-16-le")) // 2


def test_byte_positions_reach_the_end_of_the_text(spark, tmp_path):
    documents(spark, tmp_path, {k: v or "" for k, v in MIXED.items()})
    got = {r.unit_ix: ((r.line, r.col), (r.middle_line, r.middle_col), (r.end_line, r.end_col)) for r in Q.byte_positions(spark, str(tmp_path)).collect()}
    size = lambda t: len(t.encode())
    assert got == {k: tuple(position(t, at) for at in (size(t[:200]), size(t) // 2, size(t))) for k, t in ((k, v or "") for k, v in MIXED.items())}


def test_extract_python_takes_every_word(spark, tmp_path):
    word = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(4))
    texts = {0: " ".join(word(i) for i in range(1500)), 1: "One two, three four five.", 2: "a b", 3: ""}
    documents(spark, tmp_path, texts)
    rows = Q.extract_python(spark, str(tmp_path)).orderBy("doc_id", "start_byte").collect()
    assert [r.name for r in rows if r.doc_id == "0"] == [f"f_{word(i)}" for i in range(1500)]
    assert [r.name for r in rows if r.doc_id == "1"] == ["f_one", "f_two", "f_three", "f_four", "f_five"]
    assert {(r.n_representations, r.n_references) for r in rows} == {(7, 2)} and {r.doc_id for r in rows} == {"0", "1"}


def test_usage_lines_take_every_line_item(spark, tmp_path):
    parts = [(i, f"B{i % 2}", f"T{i % 7}", i % 3) for i in range(1, 61)]
    items = [(o, (o * 7 + n * 3) % 60 + 1, n) for o in range(40) for n in range(1, 5)]
    write(spark, tmp_path, "part", parts, "p_partkey bigint, p_brand string, p_type string, p_size int")
    write(spark, tmp_path, "lineitem", items, "l_orderkey bigint, l_partkey bigint, l_linenumber int")
    name, brand = {p: f"{t}_{z}" for p, _, t, z in parts}, {p: b for p, b, _, _ in parts}
    lines = {}
    for o, p, _ in items:
        for d in name:
            if brand[d] == brand[p] and name[d] == name[p % 50 + 1] and d != p:
                lines.setdefault(d, set()).add(f"{name[p]}: call {o % 5}")
    want = {(d, hashlib.sha256("\n".join(sorted(x)).encode()).hexdigest(), len(x)) for d, x in lines.items()}
    assert {(r.unit_ix, r.content_hash, r.n_lines) for r in Q.usage_lines(spark, str(tmp_path)).collect()} == want


def test_usage_lines_of_one_name_are_made_once(spark):
    from spindrift.operators import usage

    n = 60
    # every unit has one name and calls it; two of them share their snippet
    units = [(i, "p", "x::f" if i % 2 else "f") for i in range(n)] + [(n, "q", "f"), (n + 1, "p", "g"), (n + 2, "p", "<anonymous>")]
    sites = [("p", i, "f", f"f({i // 2 * 2 if i in (4, 6) else i})") for i in range(n)] + [("p", 4, "y.f", "f(6)"), ("p", n + 1, "f", None), ("p", n + 2, "g", "g()"), ("q", n, "f", "f()"), (None, 1, "f", "f"), ("p", None, "f", "f"), ("p", 999, "f", "f")]
    references = spark.createDataFrame(sites, "project_label string, caller_ix bigint, callee string, snippet string")
    table = spark.createDataFrame(units, "unit_ix bigint, project_label string, name string")
    name, bare = {u: s for u, _, s in units}, {u: s.split(":")[-1].split(".")[-1] for u, _, s in units}
    want = {}
    for u, p, _ in units:
        lines = {name[c] + (f": {s}" if s else "") for q, c, callee, s in sites if q == p and c in name and c != u and bare[u] == callee.split(".")[-1]}
        if lines:
            want[u] = "\n".join(sorted(lines))
    assert {r.unit_ix: r.content for r in usage.usage_channel(references, table).collect()} == want
    # what is shuffled for the texts: a line for each site, not for each site and unit
    many = spark.createDataFrame([(i, "p", "f" if i < 2000 else f"g{i}") for i in range(4000)], "unit_ix bigint, project_label string, name string")
    calls = spark.createDataFrame([("p", 2000 + i, "f", "f()") for i in range(2000)], "project_label string, caller_ix bigint, callee string, snippet string")
    out = usage.usage_channel(calls, many).select("unit_ix", "content_hash")
    assert len({(r.content_hash) for r in out.collect()}) == 1
    assert most_rows(out) <= 4000


def test_bm25_topk_needs_no_index(spark, tmp_path):
    import os

    from spindrift.checkpoints import shared_folder

    documents(spark, tmp_path, {1: "the thing", 2: "The thing, ciónar", 3: "the the entre", 4: "", 5: "nothing here", 6: "the thing"})
    folder = shared_folder(spark).removeprefix("file:")
    had = {x for x in os.listdir(folder) if x.startswith("lexical-")}
    scan = [tuple(r) for r in Q.bm25_topk(spark, str(tmp_path)).collect()]
    assert {x for x in os.listdir(folder) if x.startswith("lexical-")} == had
    assert [u for u, _ in scan][:3] and scan == [tuple(r) for r in Q.bm25_index(spark, str(tmp_path)).collect()]
    index = Q.stored_index(spark, str(tmp_path))
    index.build()
    index.units = None  # it is read now
    assert [(r.unit_ix, round(r.score, 6)) for r in index(Q.BM25_QUERY, 20).collect()] == scan


def most_rows(df):
    """The most rows that an operator of a plan that has run gave."""
    found, todo = [0], [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        if p.metrics().contains("numOutputRows"):
            found.append(p.metrics().apply("numOutputRows").value())
        todo += [p.executedPlan()] if "AdaptiveSparkPlanExec" in p.getClass().getName() else [p.plan()] if "QueryStageExec" in p.getClass().getName() else [p.children().apply(i) for i in range(p.children().size())]
    return max(found)
