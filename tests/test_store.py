"""Publishing: atomic, repeatable, and a stable identity across edits."""

import pytest
from pyspark.sql import functions as F

from spindrift.extract.python import extract
from spindrift.plans.index_run import index
from spindrift.sources import config, files, models
from spindrift.sources.store import STEPS, Store

BODY = "    total = a + b * 2\n    return print(total, sorted([a, b]))\n"
ONE = f"def alpha(a, b):\n{BODY}"


def docs(spark, texts):
    return files.memory_documents(spark, texts)


def test_publish(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    assert index(spark, store, "p", "mem", docs(spark, {"a.py": ONE, "b.py": ONE.replace("alpha", "gamma")}))["units"] == 2
    before = {r.name: r.entity_id for r in store.table("units").collect()}
    changed = {"a.py": ONE.replace("alpha", "beta")}
    for step in (STEPS[1], STEPS[5], STEPS[-1]):

        def fault(at, step=step):
            if at == step:
                raise OSError(step)

        with pytest.raises(OSError):
            index(spark, store, "p", "mem", docs(spark, changed), fault=fault)
        assert store.generation == 1 and {r.name for r in store.table("units").collect()} == {"alpha", "gamma"}
    report = index(spark, store, "p", "mem", docs(spark, changed))
    assert (report["indexed"], report["removed"], report["total_units"]) == (1, 1, 1)
    after = {r.name: r.entity_id for r in store.table("units").collect()}
    assert after == {"beta": before["alpha"]}  # the same body under another name
    assert store.table("representations").filter(F.col("kind") == "signature").count() == 1


def test_extraction():
    units = extract('class A:\n    def f(self, x):\n        """Docs."""\n        # note\n        return g(x) + len([1, 2, x])\n')
    (u,) = units
    reps = {r["kind"]: r["content"] for r in u["representations"]}
    assert (u["name"], u["scope"]) == ("f", "A") and reps["documentation"] == "Docs." and "note" not in reps["implementation"]
    assert {r["callee"] for r in u["references"]} == {"g", "len"}
    assert extract("def broken(:") == []


def test_scan(tmp_path):
    for name in ("src/keep.rs", "vendor/skip.rs", "generated.rs", "ignored/d.rs", ".hidden.rs", "notes.txt"):
        f = tmp_path / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text("x")
    (tmp_path / ".gitignore").write_text("ignored/\n")
    assert files.scan_files(str(tmp_path), ["vendor/**", "generated.rs"]) == [("src/keep.rs", "rust")]


def test_settings(tmp_path):
    (tmp_path / config.FILE).write_text('root = true\n[index]\nexclude = ["target/**"]\n')
    sub = tmp_path / "docs"
    sub.mkdir()
    (sub / config.FILE).write_text('[index]\nexclude = ["fixtures/**"]\n')
    assert config.discover(str(sub)).excludes() == ["target/**", "docs/fixtures/**"]
    r = config.Registry(str(tmp_path / "r.json"))
    a, b = r.register(str(tmp_path / "x/app"), "app", "d"), r.register(str(tmp_path / "y/app"), "app", "d")
    assert (a["label"], b["label"]) == ("app", "app-2") and r.find(str(tmp_path / "y/app/z")) is b


def test_references():
    assert models.parse_ref("hf:o/n@r") == models.ModelRef("hub", "o/n", "r")
    assert models.parse_ref("o/n").kind == "hub" and models.parse_ref("dir:/x").name == "/x" and models.parse_ref("small").kind == "named"
    with pytest.raises(ValueError):
        models.parse_ref("hf:bad")
