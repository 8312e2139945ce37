"""The command line: one JSON line (version, event, data) for each result.

``python -m spindrift --store DIR COMMAND``. Exit status: 0 done, 130 interrupted,
2 anything else.
"""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import asdict
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.extract.python import MAX_CHARS, MIN_NODES
from spindrift.operators import embedding as E
from spindrift.plans import embed, index_run
from spindrift.plans.hybrid import candidate_pool, condition_of, hybrid_search, shape_results
from spindrift.plans.journal import Journal
from spindrift.sources import config, files, models, read
from spindrift.sources.store import Store, envelope


def say(event: str, data) -> None:
    print(json.dumps({"version": 1, "event": event, "data": data}, sort_keys=True, default=str), flush=True)


def say_rows(df: DataFrame, event: str) -> None:
    for r in envelope(df, event).collect():  # results cut to a limit, or catalogues
        print(r.line, flush=True)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="spindrift")
    p.add_argument("--store", required=True)
    p.add_argument("--registry", default=str(Path.home() / ".spindrift" / "projects.json"))
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *aliases: str):
        return sub.add_parser(name, aliases=aliases)

    c = command("index")
    c.add_argument("--project", action="append", required=True, metavar="LABEL=PATH")
    _index_options(c)
    c = command("runs")
    c.add_argument("--run", type=int)
    c.add_argument("--limit", type=int, default=10)
    for name in ("abandon", "supersede"):
        command(name).add_argument("--run", type=int, required=True)
    c = command("embed")
    c.add_argument("--space", action="append", required=True, metavar="ID=CHANNEL")
    c.add_argument("--dimensions", type=int, default=256)
    c.add_argument("--document-prompt")
    c.add_argument("--output-dimensions", type=int)
    c = command("search", "query")
    c.add_argument("text", nargs="?", default="")
    c.add_argument("--limit", type=int, default=10)
    c.add_argument("--space")
    c.add_argument("--mode", default="hybrid")
    c.add_argument("--where", default="")
    c.add_argument("--task")
    c.add_argument("--list-tasks", action="store_true")
    c = command("models")
    c.add_argument("reference")
    c = command("add")
    c.add_argument("path", nargs="?", default=".")
    c.add_argument("--label")
    _index_options(c)
    c = command("remove")
    c.add_argument("needle")
    c = command("reindex")
    c.add_argument("needle", nargs="?")
    _index_options(c)
    command("list")
    command("status")
    c = command("lsp-enrich")
    c.add_argument("relations", help="a Parquet folder of relations")
    c.add_argument("--provenance", required=True)
    return p


def _index_options(c: argparse.ArgumentParser) -> None:
    c.add_argument("--language", action="append")
    c.add_argument("--exclude", action="append", default=[])
    c.add_argument("--body-node-count-threshold", type=int, default=MIN_NODES)
    c.add_argument("--max-body-chars", type=int, default=MAX_CHARS)
    c.add_argument("--retention", default="full", choices=("full", "report", "minimal"))
    c.add_argument("--restart", action="store_true")


def run_index(spark: SparkSession, store: Store, roots: dict[str, str], a: argparse.Namespace) -> dict:
    """One run over folders, kept in the journal."""
    journal = Journal(store)
    settings = json.dumps([sorted(roots.items()), a.retention, a.body_node_count_threshold, a.max_body_chars, sorted(a.exclude), sorted(a.language or [])])
    run, _ = journal.create_or_resume(list(roots), settings, resume=not a.restart)
    owner = journal.claim(run)
    try:
        sources = {}
        for label, root in roots.items():
            found = config.discover(root)
            sources[label] = (root, files.file_documents(spark, root, [*(found.excludes() if found else []), *a.exclude], a.language))
        journal.set_phase(run, owner, "indexing")
        report = index_run.index_projects(spark, store, sources, a.retention, a.body_node_count_threshold, a.max_body_chars)
        journal.ready(run, owner)
        journal.commit(run, owner)
        return report
    except (KeyboardInterrupt, RuntimeError) as x:
        journal.pause(run, owner, str(x) or "interrupted")
        raise
    except Exception as x:
        journal.fail(run, owner, str(x)[:500])
        raise


def run_search(spark: SparkSession, store: Store, a: argparse.Namespace) -> DataFrame:
    """Hybrid where the store has a space to ask, else lexical; tests are left out unless asked for."""
    tables = store.snapshot()
    spaces = [r.space_id for r in tables["spaces"].collect()]
    chosen = a.space or (spaces[0] if len(spaces) == 1 else None)
    units = tables["units"].withColumn("unit_ix", F.xxhash64("version_id"))
    vectors = dense = None
    if chosen and a.mode != "lexical":
        row = read.space(tables, chosen)
        backend = E.HashBackend(row.dimensions)
        embed.check_contract(row, backend.contract)
        if a.task is not None and a.task not in E.TASKS:
            raise ValueError(f"there is no task {a.task}; there are {', '.join(E.TASKS)}")
        rendered = spark.range(1).select(E.render_query(backend.contract, F.lit(a.text), (a.task, E.TASKS[a.task]) if a.task else None).alias("t")).first().t
        v = E.normalized(backend.embed([rendered]))
        if row.output_dimensions and row.output_dimensions < row.dimensions:
            v = E.normalized(v[:, : row.output_dimensions])
        vectors, dense = read.index_of_space(tables, chosen).filter("embedding IS NOT NULL").select("unit_ix", "embedding"), v[0].tolist()
    edges = None
    if tables["relations"].limit(1).count():
        ends = units.select("entity_id", "unit_ix")
        edges = tables["relations"].join(ends.select(F.col("entity_id").alias("from_entity_id"), F.col("unit_ix").alias("f")), "from_entity_id").join(ends.select(F.col("entity_id").alias("to_entity_id"), F.col("unit_ix").alias("t")), "to_entity_id").select("edge_ord", "f", "t")
    mode = a.mode if vectors is not None or a.mode == "dense" else "lexical"
    hits = hybrid_search(units, a.limit, a.text, vectors, dense, None, a.where, edges, mode, index=store.lexical)
    return shape_results(hits, units)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    if a.command in ("search", "query") and a.list_tasks:
        for task, instruction in E.TASKS.items():
            say("task", {"task": task, "instruction": instruction})
        return 0
    spark = spark or SparkSession.builder.appName("spindrift").getOrCreate()
    store, registry = Store(spark, a.store), config.Registry(a.registry)
    try:
        if a.command == "index":
            say("report", run_index(spark, store, dict(x.split("=", 1) for x in a.project), a))
        elif a.command == "runs":
            journal = Journal(store)
            for r in [journal.run(a.run)] if a.run is not None else journal.runs(a.limit):
                say("run", journal.status(r["run_id"]))
        elif a.command in ("abandon", "supersede"):
            getattr(Journal(store), a.command)(a.run)
            say("run", Journal(store).run(a.run))
        elif a.command == "embed":
            for x in a.space:
                space, channel = x.split("=", 1)
                say("embedded", embed.embed_space(store, space, channel, lambda: E.HashBackend(a.dimensions), a.document_prompt, a.output_dimensions))
        elif a.command in ("search", "query"):
            say_rows(run_search(spark, store, a), "hit")
        elif a.command == "models":
            say("model", asdict(models.resolve(a.reference)))
        elif a.command == "add":
            p = registry.register(a.path, a.label or Path(a.path).absolute().name, a.store)
            registry.save()
            say("report", run_index(spark, store, {p["label"]: p["root"]}, a))
        elif a.command == "reindex":
            known = {r.label: r.locator for r in store.table("projects").collect()}
            label = a.needle or (next(iter(known)) if len(known) == 1 else None)
            if label not in known:
                raise ValueError(f"there is no project {label}; there are {', '.join(sorted(known)) or 'none'}")
            say("report", run_index(spark, store, {label: known[label]}, a))
        elif a.command == "remove":
            found = registry.find(a.needle)
            label = found["label"] if found else a.needle
            say("report", index_run.remove(spark, store, label))
            if found:
                registry.remove(label)
                registry.save()
        elif a.command == "list":
            say_rows(read.list_projects(store.snapshot()), "project")
        elif a.command == "status":
            tables = store.snapshot()
            say("status", read.embedding_totals(tables).first().asDict() | {"generation": store.generation, "projects": tables["projects"].count(), "runs": len(Journal(store).runs())})
        elif a.command == "lsp-enrich":
            store.replace_relations(spark.read.parquet(a.relations), store.generation, a.provenance)
            say("relations", {"generation": store.generation, "provenance": a.provenance})
        return 0
    except KeyboardInterrupt:
        return 130
    except Exception as x:
        print(f"{type(x).__name__}: {x}"[:2000], file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
