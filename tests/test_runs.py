"""Stores over several projects, every publish fault, the stored index, the journal, embedding and the command line."""

import json

import pytest
from pyspark.sql import functions as F

from spindrift.operators import embedding as E
from spindrift.operators.lexical import bm25
from spindrift.plans import embed, index_run
from spindrift.plans.journal import Journal, NotOwner
from spindrift.sources import files, read
from spindrift.sources.store import STEPS, Store

BODY = "    total = a + b * 2\n    return print(total, sorted([a, b]))\n"
ONE, TWO = f"def alpha(a, b):\n{BODY}", f"def gamma(a, b):\n{BODY.replace('2', '3')}"


def docs(spark, texts):
    return files.memory_documents(spark, texts)


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    s = Store(spark, str(tmp_path_factory.mktemp("s")), buckets=8)
    index_run.index_projects(spark, s, {"p": ("mem:p", docs(spark, {"a.py": ONE, "b.go": "package b\n// Sum adds.\nfunc Sum(a int, b int) int { t := a + b; fmt.Println(t, a, b); return t * 2 }\n"})), "q": ("mem:q", docs(spark, {"c.py": TWO}))})
    return s


def test_projects_become_visible_together(spark, store):
    units = {(r.project_label, r.name) for r in store.table("units").collect()}
    assert units == {("p", "alpha"), ("p", "Sum"), ("q", "gamma")} and store.manifest()["report"]["projects"]["p"]["units"] == 2
    before = store.manifest()
    parts = [index_run.prepare(store, p, f"mem:{p}", docs(spark, t), 2, "full", 10, 10_000) for p, t in (("p", {"a.py": ONE.replace("alpha", "beta")}), ("q", {"c.py": ONE}))]
    rows = [parts[0][n].unionByName(parts[1][n]) for n in ("actions", "files", "units", "representations", "references", "texts")]
    for step in STEPS:

        def fault(at, step=step):
            if at == step:
                raise OSError(step)

        with pytest.raises(OSError):
            store.publish(2, {"p": "mem:p", "q": "mem:q"}, *rows, fault=fault)
        assert store.manifest() == before
    with pytest.raises(ValueError):
        index_run.index_projects(spark, store, {"p": ("mem:p", None)}, only="z")


def test_a_publish_leaves_untouched_buckets(spark, store):
    old = store.manifest()
    report = index_run.index(spark, store, "q", "mem:q", docs(spark, {"c.py": TWO, "d.py": ONE.replace("alpha", "delta")}))
    new = store.manifest()
    assert (report["indexed"], report["skipped"], report["total_units"]) == (1, 1, 4)
    same = {b for b, own in old["folders"]["units"].items() if new["folders"]["units"].get(b) == own}
    assert len(same) >= len(old["folders"]["units"]) - 1
    index_run.index(spark, store, "q", "mem:q", docs(spark, {"c.py": TWO}))
    assert {r.name for r in store.table("units").filter("project_label = 'q'").collect()} == {"gamma"}
    assert store.collect_garbage(older_than_s=-1) > 0 and store.table("units").count() == 3


def test_the_stored_index_ranks_as_a_scan_does(spark, store):
    texts = store.table("representations").filter("kind = 'full_source'").select("version_id", "content")
    units = store.table("units").join(texts, "version_id").withColumn("unit_ix", F.xxhash64("version_id"))
    for q in ("sorted total", "Sum adds fmt", "gamma gamma", "nothing_there", "!!"):
        scan, kept = ({r.unit_ix: round(r.score, 9) for r in x.collect()} for x in (bm25(units, q, 10), store.lexical(q, 10)))
        assert scan == kept
    gone = index_run.index(spark, store, "p", "mem:p", docs(spark, {"a.py": ONE}))
    assert gone["removed"] == 1 and store.lexical("Sum", 5).count() == 0


def test_snapshot_and_spaces(spark, store):
    out = embed.embed_space(store, "code", "implementation", lambda: E.HashBackend(16), output_dimensions=8)
    assert out["inserted"] == out["pending"] > 0 and embed.embed_space(store, "code", "implementation", lambda: E.HashBackend(16), output_dimensions=8)["pending"] == 0
    with pytest.raises(ValueError):
        embed.embed_space(store, "code", "implementation", lambda: E.HashBackend(32), output_dimensions=8)
    t = store.snapshot()
    with pytest.raises(ValueError):
        read.space(t, "none")
    assert read.effective_dimensions(read.space(t, "code")) == 8
    hits = embed.search_text(store, "code", "total sorted alpha", E.HashBackend(16), 2).collect()
    assert len(hits) == 2 and hits[0].score >= hits[1].score
    with pytest.raises(ValueError):
        embed.search_text(store, "code", "x", E.HashBackend(32), 2)
    snap = read.snapshot(t, ["code"])
    rows = snap["units"].orderBy("unit_ix").collect()
    assert [(r.project_label, r.name) for r in rows] == [("p", "alpha"), ("q", "gamma")] and [r.unit_ix for r in rows] == [0, 1]
    assert [x.kind for x in rows[0].representations][:3] == ["full_source", "implementation", "body"]
    assert snap["vectors"].count() == 2 and read.embedding_totals(t).first().pending == 0
    assert {r.space_id for r in read.spaces_with_models({"spaces": t["spaces"], "models": t["models"].withColumn("model_id", F.col("name"))}).collect()} == {"code"}
    # vectors of texts that no unit has are dropped at the next publish
    index_run.remove(spark, store, "q")
    assert store.table("vectors").count() == 1 and read.list_projects(store.snapshot()).count() == 1


def test_texts_that_were_not_kept_are_recovered(spark, tmp_path):
    s, source = Store(spark, str(tmp_path / "m"), buckets=2), docs(spark, {"a.py": ONE})
    index_run.index(spark, s, "p", "mem", source, retention="minimal")
    assert embed.embed_space(s, "code", "implementation", lambda: E.HashBackend(8))["inserted"] == 0
    out = embed.embed_space(s, "code", "implementation", lambda: E.HashBackend(8), documents=source)
    assert (out["recovered"], out["inserted"]) == (1, 1)
    made = embed.embed_channels(s, lambda: E.HashBackend(8), source)
    assert {x["space"] for x in made} >= {"default/implementation", "default/signature"}


def test_journal(spark, tmp_path):
    now = [1000.0]
    s = Store(spark, str(tmp_path / "j"), buckets=2)
    j = Journal(s, clock=lambda: now[0])
    run, resumed = j.create_or_resume(["p"], "f1")
    assert (run, resumed) == (1, False) and j.create_or_resume(["p"], "f1") == (1, True)
    a = j.claim(run)
    with pytest.raises(NotOwner):
        j.claim(run, "b")
    with pytest.raises(NotOwner):
        j.heartbeat(run, "b")
    seen = spark.createDataFrame([("1", "a.py", "python", "x", "upsert"), ("2", "b.py", "python", "y", "upsert"), ("3", "c.py", "python", "z", "unchanged")], "doc_id string, path string, language string, fingerprint string, action string")
    j.stage(run, a, "p", seen)
    ids = lambda *d: spark.createDataFrame([("p", x) for x in d], "project_label string, doc_id string")
    assert j.checkpoint(run, a, ids("1")) == 0 and j.begin(run, a, ids("1", "2")) == 2 and j.checkpoint(run, a, ids("1")) == 1
    assert j.error(run, a, ids("2").withColumn("error", F.lit("boom"))) == 1
    with pytest.raises(NotOwner):
        j.ready(run, a)
    st = j.status(run)
    assert (st["documents"], st["ready"], st["errors"], st["pending"]) == (3, 2, 1, 0)
    now[0] += 60
    b = j.claim(run, "b")  # the first owner is gone
    st = j.status(run)
    assert j.run(run)["note"] == "process_lost" and (st["pending"], st["reused"], st["errors"]) == (1, 1, 0)
    # the same documents keep their state, changed ones wait again, vanished ones go
    j.stage(run, b, "p", seen.filter("doc_id <> '3'").withColumn("fingerprint", F.when(F.col("doc_id") == "2", "y2").otherwise(F.col("fingerprint"))))
    assert {(r.doc_id, r.state) for r in j.documents(run).collect()} == {("1", "ready"), ("2", "pending")}
    j.begin(run, b, ids("2"))
    assert j.reset(run, b, ids("2")) == 1 and j.begin(run, b, ids("2")) == 1 and j.checkpoint(run, b, ids("2")) == 1
    assert j.status(run)["retried"] == 1
    digest = j.digest(run)
    j.validate(run, digest)
    with pytest.raises(ValueError):
        j.validate(run, "other")
    j.ready(run, b)
    j.commit(run, b)
    with pytest.raises(NotOwner):
        j.claim(run, "c")
    other, _ = j.create_or_resume(["p", "q"], "f2")
    third, _ = j.create_or_resume(["q"], "f3")
    assert j.run(other)["state"] == "superseded" and j.refreshed(third, j.claim(third)) == 1
    j.abandon(third)
    with pytest.raises(ValueError):
        j.supersede(third)
    assert [r["run_id"] for r in j.runs(2)] == [third, other] and j.collect(1) == [other, run]


def test_command_line(spark, tmp_path, capsys):
    from spindrift.__main__ import main

    root = tmp_path / "src"
    root.mkdir()
    (root / "a.py").write_text(ONE)
    (root / "skip.py").write_text(TWO)
    call = lambda *a: (main(["--store", str(tmp_path / "st"), "--registry", str(tmp_path / "r.json"), *a], spark), [json.loads(x) for x in capsys.readouterr().out.splitlines()])
    code, out = call("index", "--project", f"p={root}", "--exclude", "skip.py")
    assert code == 0 and out[-1]["data"]["units"] == 1
    assert call("search", "alpha sorted", "--limit", "3")[1][0]["data"]["name"] == "alpha"
    assert call("embed", "--dimensions", "16", "--space", "code=implementation")[1][0]["data"]["inserted"] == 1
    assert call("search", "alpha sorted", "--space", "code", "--mode", "dense")[1][0]["data"]["name"] == "alpha"
    assert call("list")[1][0]["data"] == {"label": "p", "locator": str(root), "last_run_id": 1, "units": 1}
    assert call("status")[1][0]["data"]["spaces"] == 1 and call("runs")[1][0]["data"]["state"] == "committed"
    assert len(call("search", "--list-tasks")[1]) == 5
    (root / "a.py").write_text(ONE.replace("alpha", "beta"))
    assert call("reindex", "p", "--exclude", "skip.py")[1][-1]["data"]["indexed"] == 1
    assert call("remove", "p")[0] == 0 and call("list")[1] == []
    assert call("add", str(root), "--label", "again")[1][-1]["data"]["units"] >= 1
    assert call("abandon", "--run", "99")[0] == 2
