"""Kernels on tiny inputs: the results that the engine promises."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.functions import text as T
from spindrift.functions import vectors as V
from spindrift.operators import embedding as E
from spindrift.operators import filters, fusion, graph, identity, intervals, ranking, usage
from spindrift.operators import incremental as inc


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_text(spark):
    assert one(spark, T.normalize(F.lit("\t let  total =\n  1 + 2; "))) == "let total = 1 + 2;"
    pair = lambda a, b: F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"))
    assert one(spark, T.strip_ranges(F.lit("abcdefghij"), F.array(pair(2, 4), pair(3, 6), pair(8, 10)))) == "abgh"
    assert one(spark, T.declared_name_byte(F.lit("func (a *adder) add("), F.lit("add"))) == 16
    assert one(spark, T.declared_name_byte(F.lit("fn addr("), F.lit("add"))) is None
    assert one(spark, T.clean_docstring(F.lit('r"""  About it. """'))) == "About it."
    for raw in ("Vec<Map<K, V>>::new", "a.b.c!", "x<y", "<T>", "std::fmt::  "):
        assert one(spark, T.symbol_name(F.lit(raw))) == T.symbol_name_exact(raw)
    assert T.callee_tail("a.b(c.d).e", 2) == "b(c.d).e"


def test_compression():
    long = "The application that we have been running for months would not start because the " * 2 + "configuration loader rejects every environment"
    short = T.compress_query(long, 16, 25)
    assert short and "application" in short and "the " not in short and len(short.split()) <= 16
    assert T.compress_query("parse flags", 16, 25) is None and T.compress_query("parse flags", 16, 0) is None


def test_vectors(spark):
    vec = lambda *x: F.array(*[F.lit(float(v)) for v in x])
    assert one(spark, V.project(vec(3, 4, 100, -7), 2)) == pytest.approx([0.6, 0.8])
    assert one(spark, V.normalize(vec(0, 0))) == [0.0, 0.0]
    with pytest.raises(Exception):
        one(spark, V.project(vec(1, 2), 3))


def test_filters(spark):
    row = spark.createDataFrame([("main", "rust", "function", "parse", "Parser", "src/parser.rs", 20)], "project_label string, language_id string, kind string, name string, scope string, relative_path string, body_node_count int")
    assert filters.where(row, "path=src/** scope=Parser min_nodes=10").count() == 1
    assert filters.where(row, "path=tests/**").count() == 0
    assert filters.where(row, "path=*.rs").count() == 0 and filters.where(row, "path=src/*.rs").count() == 1
    assert filters.where(row, "name=par* tests=only").count() == 0
    for bad in ("colour=red", "name", "min_nodes=x", "tests=maybe", "path=[a"):
        with pytest.raises(ValueError):
            filters.WhereFilter.parse(bad)


def test_vector_store(spark):
    vec = spark.createDataFrame([(0, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0])], "unit_ix bigint, embedding array<float>")
    for block in (1, 2, 3, 100):
        assert {(r.a, r.b) for r in ranking.similar_pairs(vec, 0.0, block).collect()} == {(0, 2), (0, 3), (2, 3)}
        assert [(r.a, r.b) for r in ranking.similar_pairs(vec, 0.5, block).collect()] == [(0, 2)]
    units = spark.createDataFrame([(0,), (1,)], "unit_ix bigint").join(vec, "unit_ix", "left")
    best = {r.a: r.b for r in ranking.top_k_between(units, vec.filter("unit_ix > 1"), 5, 0.5).collect()}
    assert best == {0: 2, 1: None}


def test_fusion(spark):
    lists = [[7, 3, 9], [3, 11]]
    rows = [spark.createDataFrame([(u, r + 1, "s", 1.0, k) for r, u in enumerate(x)], "unit_ix bigint, rank int, source string, weight double, list_ord int") for k, x in enumerate(lists)]
    out = fusion.fuse(rows).collect()
    assert [r.unit_ix for r in out][:2] == [3, 7] and math.isclose(out[0].score, 1 / 62 + 1 / 61)


def test_graph(spark):
    edges = lambda rows: spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(rows)], "edge_ord bigint, f bigint, t bigint")
    seeds = lambda *s: spark.createDataFrame([(u, k) for k, u in enumerate(s)], "unit_ix bigint, seed_rank int")
    base = [(0, 1), (2, 0)]
    near = lambda s, e, n=10: [r.unit_ix for r in graph.expand(s, edges(e), n).collect()]
    assert near(seeds(0), base) == [1, 2] and near(seeds(0, 1), base) == [2] and near(seeds(0), base, 1) == [1] and near(seeds(1), base) == [0]
    assert near(seeds(1), [*base, (1, 2), (1, 2)]) == [2, 0]


def test_packing():
    assert max(E.pack_batches([(10, 1)] * 5, max_items=2)) == 2
    assert max(E.pack_batches([(10, 1)] * 6, max_chars=25)) == 2
    got = E.pack_batches([(2000, 500)] * 6, max_area=1_000_000)
    assert [got.count(b) for b in sorted(set(got))] == [4, 2]
    assert E.pack_batches([(10**9, 5), (1, 1)]) == [0, 1]


def test_token_stats(spark):
    df = spark.createDataFrame([(1, n) for n in (500, 300, 200, 100, 100)], "g int, t int")
    r = E.token_stats(df, "t", ["g"], 500).first()
    assert (r.n, r.truncated, r.p50, r.max_tokens) == (5, 1, 200, 500)


def test_prompts(spark):
    asked = E.Contract("m", 4, prompts=E.Prompts("instruction", "{instruction}: {query}"))
    assert one(spark, E.render_query(asked, F.lit("a {query}"), ("t", "find"))) == "find: a {query}"
    with pytest.raises(ValueError):
        E.render_query(asked, F.lit("a"))
    with pytest.raises(ValueError):
        E.render_query(E.Contract("m", 4), F.lit("a"), ("t", "find"))
    with pytest.raises(ValueError):
        E.render_document(E.Contract("m", 4, prompts=E.Prompts("paired")), F.lit("a"))


def test_identity():
    unit = lambda name, body, start=0: {"project_label": "p", "doc_id": "d", "kind": "function", "scope": None, "name": name, "start_byte": start, "end_byte": start + 5, "source_hash": "s", "normalized_body_hash": body}
    prior = [unit("a", "x") | {"entity_id": "e1"}, unit("b", "y") | {"entity_id": "e2"}]
    got = [(r["entity_id"], r["match"]) for r in identity.assign(prior, [unit("a", "z"), unit("c", "y"), unit("c2", "y")])]
    assert got[:2] == [("e1", "key"), ("e2", "body")] and got[2][1] == "minted"
    two = [unit("a", "x") | {"entity_id": "e1"}, unit("b", "x") | {"entity_id": "e2"}]
    assert identity.assign(two, [unit("c", "x")])[0]["match"] == "minted"


def test_identity_of_many_documents(spark):
    """Documents across and inside batches, without a call for each; names missing, ids missing, a side missing."""
    fields = "project_label string, doc_id string, kind string, scope string, name string, start_byte bigint, end_byte bigint, source_hash string, normalized_body_hash string"
    unit = lambda d, k, name, body: ("p", d, "function", "S" if k % 2 else None, name, k * 10, k * 10 + 5, f"s{k}", body)
    docs = [None if d == 7 else f"d{d}" for d in range(40)]
    old = [(*unit(d, k, f"n{k}", f"b{k % 3}"), f"e{d}-{k}") for i, d in enumerate(docs) for k in range(i % 6) if i != 5]
    new = [unit(d, k, f"n{k}" if k % 2 else f"m{k}", f"b{k % 4}") for i, d in enumerate(docs) for k in range(i % 5) if d]
    names = [c.split()[0] for c in fields.split(", ")]
    want = set()
    for d in set(docs):
        at = lambda rows, n: [dict(zip(n, r)) for r in sorted(rows, key=lambda r: r[5]) if r[1] == d]
        want |= {(r["doc_id"], r["start_byte"], r["entity_id"], r["version_id"], r["match"]) for r in identity.assign(at(old, [*names, "entity_id"]), at(new, names))}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        out = identity.assign_identity(spark.createDataFrame(old, fields + ", entity_id string"), spark.createDataFrame(new, fields))
        rows = out.collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(rows) == len(new) and {(r.doc_id, r.start_byte, r.entity_id, r.version_id, r.match) for r in rows} == want
    assert "FlatMapGroups" not in out._jdf.queryExecution().executedPlan().toString()


def test_hash_embed_hashes_a_token_once(spark):
    texts = {1: "a bb a_bb, ccc 12 é", 2: None, 3: "", 4: "कि कि x\u0301y Ⅷ ②", 5: " ".join(f"w{i % 90}" for i in range(5000)), 6: "a " * 3000}
    df = spark.createDataFrame(list(texts.items()), "unit_ix bigint, content string")
    words = {r.unit_ix: r.w or [] for r in df.selectExpr("unit_ix", r"regexp_extract_all(content, '[\\p{IsAlphabetic}\\p{N}]+', 0) AS w").collect()}
    for d in (5, 48):
        counts = {}
        for u, ws in words.items():
            counts[u] = np.zeros(d)
            for w in ws:
                counts[u][int.from_bytes(hashlib.sha256(w.encode()).digest()[:8], "little") % d] += 1
        raw = E.hash_embed(df, "content", d, normalized=False)
        assert {r.unit_ix: r.embedding for r in raw.collect()} == {u: c.tolist() for u, c in counts.items()}
        unit = {u: (c / (np.sqrt((c**2).sum()) or 1)).astype(np.float32).tolist() for u, c in counts.items()}
        assert {r.unit_ix: r.embedding for r in E.hash_embed(df, "content", d).collect()} == unit
    assert "sha2(" not in raw._jdf.queryExecution().executedPlan().toString()


def test_intervals(spark):
    units = spark.createDataFrame([(1, "d", 0, 9000), (2, "d", 4000, 4200), (3, "d", 4000, 4100), (4, "e", 0, 9)], "unit_ix int, doc string, start int, end int")
    points = spark.createDataFrame([(1, "d", 4050), (2, "d", 4150), (3, "d", 8999), (4, "d", 9000)], "ref_id int, doc string, pos int")
    assert {r.ref_id: r.unit_ix for r in intervals.innermost(points, units, "doc", "pos").collect()} == {1: 3, 2: 2, 3: 1}


def test_usage(spark):
    units = spark.createDataFrame([(1, "p", "helper"), (2, "p", "caller"), (3, "q", "helper")], "unit_ix bigint, project_label string, name string")
    calls = spark.createDataFrame([("p", 2, "x::helper", "helper(1)"), ("p", 2, "helper", "helper(2)"), ("p", 1, "helper", "helper()")], "project_label string, caller_ix bigint, callee string, snippet string")
    rows = usage.usage_channel(calls, units).collect()
    assert [(r.unit_ix, r.content) for r in rows] == [(1, "caller: helper(1)\ncaller: helper(2)")]


def test_empty_tables(spark):
    units = spark.createDataFrame([], "unit_ix bigint, embedding array<float>")
    assert ranking.similar_pairs(units, 0.1).count() == 0
    docs = spark.createDataFrame([], "doc_id string, path string, language string, source_hash string, revision string")
    assert inc.classify(docs, docs).count() == 0 and inc.validate_documents(docs).count() == 0
