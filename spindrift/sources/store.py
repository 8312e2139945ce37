"""Published generations: immutable folders of Parquet and one manifest that names the current ones.

Tables of documents are cut into buckets by a hash of (project, document), and
vectors by their hash. The manifest names each bucket's folders. A publish writes
the buckets that hold changed documents and leaves the others' folders as they
are, then replaces the manifest in one rename, so readers see the old or the new
state, never a mixture; a failure at any step before leaves the old one in place.
Files go through Hadoop's file systems, so the root may be any URI whose file
system renames a file atomically.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.schemas import EPOCH, TABLES

#: The steps of a publish, in order; tests fail them one by one.
STEPS = ["validate", "settings", "projects", "delete", "metadata", "insert", "usage", "orphans", "dangling", "vectors", "manifest"]
IMMUTABLE = ("body_node_count_threshold", "retention", "max_body_chars")
#: Tables by document, and those by content hash; the others are catalogues and ledgers in one piece.
BY_DOCUMENT = ("files", "units", "representations", "references", "postings", "lengths")
BY_HASH = ("vectors",)
#: Buckets of a new store.
BUCKETS = 64


class Files:
    """Small files and folders on a Hadoop file system."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.gateway, self.conf = spark._jvm, spark.sparkContext._gateway, spark._jsc.hadoopConfiguration()
        self.root = root.rstrip("/")

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def system(self):
        return self.path("").getFileSystem(self.conf)

    def read(self, name: str) -> str | None:
        fs, p = self.system(), self.path(name)
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """Write and rename over what is there, in one step for readers."""
        part = self.path(f".{name}-{uuid.uuid4().hex}")
        stream = self.system().create(part, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        rename = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(part.toUri() if part.toUri().getScheme() else self.system().getUri(), self.conf).rename(part, self.path(name), options)

    def list(self, name: str) -> list[tuple[str, float]]:
        """Names and times (seconds) of what a folder holds."""
        fs, p = self.system(), self.path(name)
        return [(x.getPath().getName(), x.getModificationTime() / 1000) for x in fs.listStatus(p)] if fs.exists(p) else []

    def delete(self, name: str) -> None:
        self.system().delete(self.path(name), True)


def bucket(table: str, n: int) -> Column:
    """The bucket that a row of a table belongs to."""
    if table in BY_DOCUMENT:
        return F.pmod(F.xxhash64("project_label", "doc_id"), F.lit(n)).cast("int")
    return F.pmod(F.xxhash64("content_hash"), F.lit(n)).cast("int") if table in BY_HASH else F.lit(0)


class Store:
    """A folder with generations; every reader resolves the manifest once."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.files, self._buckets = spark, str(root).rstrip("/"), Files(spark, str(root)), buckets

    # manifest

    def manifest(self) -> dict:
        text = self.files.read("_manifest.json")
        if text is None:
            return {"epoch": EPOCH, "generation": 0, "buckets": self._buckets, "folders": {}, "settings": {}, "report": None, "lexical": [0, 0.0]}
        found = json.loads(text)
        if found["epoch"] != EPOCH:
            raise ValueError(f"the store has schema epoch {found['epoch']}, not {EPOCH}")
        return found

    def _swap(self, manifest: dict) -> None:
        self.files.write("_manifest.json", json.dumps(manifest, sort_keys=True))

    @property
    def generation(self) -> int:
        return self.manifest()["generation"]

    def setting(self, key: str):
        return self.manifest()["settings"].get(key)

    def set_setting(self, key: str, value) -> None:
        m = self.manifest()
        m["settings"][key] = value
        self._swap(m)

    # tables

    def table(self, name: str, manifest: dict | None = None, buckets: set[int] | None = None) -> DataFrame:
        """One table of a generation, or some of its buckets; the usage channel counts among the representations."""
        m = manifest or self.manifest()
        own = self._read(name, m["folders"].get(name, {}), buckets)
        return own.unionByName(self._read("usage", m["folders"].get("usage", {}))) if name == "representations" and buckets is None else own

    def _read(self, name: str, folders: dict[str, list[str]], buckets: set[int] | None = None) -> DataFrame:
        paths = [f"{self.root}/{p}" for b, own in folders.items() if buckets is None or int(b) in buckets for p in own]
        if not paths:
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(*paths)

    def snapshot(self) -> dict[str, DataFrame]:
        """All tables of one generation."""
        m = self.manifest()
        return {name: self.table(name, m) for name in TABLES}

    def _write(self, name: str, df: DataFrame, m: dict, generation: int) -> dict[str, list[str]]:
        """A new folder with a table's rows by bucket; what the manifest is to say of it."""
        folder = f"{name}/g{generation}-{uuid.uuid4().hex[:8]}"
        fields = [c.split()[0] for c in TABLES[name].split(", ")]
        rows = df.select(*fields, bucket(name, m["buckets"]).alias("__bucket"))
        if name in BY_DOCUMENT + BY_HASH:
            # a bucket's rows may be many, so they are spread over as many tasks as they fill
            rows = rows.repartition("__bucket", F.pmod(F.xxhash64(*fields[:3]), F.lit(4)))
        rows = rows.sortWithinPartitions("__bucket", "term") if name == "postings" else rows
        rows.write.option("parquet.bloom.filter.enabled#term", "true").partitionBy("__bucket").parquet(f"{self.root}/{folder}")
        return {b.removeprefix("__bucket="): [f"{folder}/{b}"] for b, _ in self.files.list(folder) if b.startswith("__bucket=")}

    def _rewritten(self, name: str, df: DataFrame, m: dict, generation: int, touched: set[int] | None) -> dict[str, list[str]]:
        """The table's folders after the touched buckets (None: all) are replaced by these rows."""
        new = self._write(name, df, m, generation)
        kept = {} if touched is None else {b: own for b, own in m["folders"].get(name, {}).items() if int(b) not in touched}
        return kept | new

    def replace(self, **tables: DataFrame) -> None:
        """New contents of whole tables, visible together."""
        m = self.manifest()
        new = {name: self._rewritten(name, df, m, m["generation"], None) for name, df in tables.items()}
        self._swap(m | {"folders": m["folders"] | new})

    def append(self, name: str, df: DataFrame) -> None:
        """More rows of a table; the folders that are there stay as they are."""
        m = self.manifest()
        old, new = m["folders"].get(name, {}), self._write(name, df, m, m["generation"])
        self._swap(m | {"folders": m["folders"] | {name: {b: old.get(b, []) + new.get(b, []) for b in old | new}}})

    def _touched(self, name: str, rows: DataFrame, m: dict) -> set[int]:
        """The buckets that hold some of the rows: at most as many numbers as there are buckets."""
        return {r.b for r in rows.select(bucket(name, m["buckets"]).alias("b")).distinct().collect()}

    # vectors, relations, representations

    def insert_vectors(self, vectors: DataFrame, width: int) -> int:
        """Append vectors whose hash a live representation has and whose key is new; returns how many."""
        from spindrift.checkpoints import checkpointed
        from spindrift.operators.incremental import orphan_vectors

        m = self.manifest()
        have, live, spaces = self.table("vectors", m), self.table("representations", m), self.table("spaces", m)
        if vectors.filter(F.size("embedding") != width).limit(1).count():
            raise ValueError(f"a vector's width isn't {width}")
        dead = orphan_vectors(vectors, live, spaces)
        keys = ["space_id", "content_hash"]
        new = checkpointed(vectors.join(dead, keys, "left_anti").join(have.select(*keys), keys, "left_anti").dropDuplicates(keys).select(*have.columns))
        n = new.count()
        if n:
            self.append("vectors", new)
        return n

    def replace_relations(self, relations: DataFrame, generation: int, provenance: str) -> None:
        """All edges of (generation, provenance) are exchanged for these."""
        have = self.table("relations")
        rest = have.filter(~((F.col("generation") == generation) & (F.col("provenance") == provenance)))
        self.replace(relations=rest.unionByName(relations.select(*have.columns)))

    def upsert_representations(self, rows: DataFrame) -> None:
        """Rows replace those of the same (version, kind), in the buckets that they fall into."""
        m = self.manifest()
        touched = self._touched("representations", rows, m)
        have = self.table("representations", m, touched)
        merged = have.join(rows, ["version_id", "kind"], "left_anti").select(*have.columns).unionByName(rows.select(*have.columns))
        self._swap(m | {"folders": m["folders"] | {"representations": self._rewritten("representations", merged, m, m["generation"], touched)}})

    # catalogues

    def find_or_create_space(self, row: dict) -> None:
        """A space of that id must have the same meaning, or be new."""
        known = self.table("spaces").filter(F.col("space_id") == row["space_id"]).collect()
        if known:
            if {k: v for k, v in known[0].asDict().items()} != row:
                raise ValueError(f"the space {row['space_id']} exists with another contract")
            return
        self.append("spaces", self.spark.createDataFrame([row], TABLES["spaces"]))

    def find_or_create_model(self, row: dict) -> str:
        """The id of the model that equals the row in all other fields (nulls equal nulls); recorded if it is new."""
        fields = [c.split()[0] for c in TABLES["models"].split(", ")][1:]
        for known in self.table("models").collect():  # a catalogue
            if all(known[f] == row.get(f) for f in fields):
                return known.model_id
        model_id = f"model-{uuid.uuid4().hex[:12]}"
        self.append("models", self.spark.createDataFrame([{f: row.get(f) for f in fields} | {"model_id": model_id}], TABLES["models"]))
        return model_id

    def record_execution(self, model: str, execution: str) -> None:
        """Append, or touch the last time it was seen."""
        have = self.table("executions")
        now = self.spark.createDataFrame([(model, execution)], "model string, execution string").withColumns({"first_seen": F.current_timestamp(), "last_seen": F.current_timestamp()})
        merged = have.unionByName(now).groupBy("model", "execution").agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))
        self.replace(executions=merged)

    def create_analysis(self, run: str, analysis: str, space_id: str | None = None) -> None:
        row = self.spark.createDataFrame([(run, analysis, space_id)], "run string, analysis string, space_id string").withColumn("created", F.current_timestamp())
        self.append("analyses", row)

    # the stored lexical index

    def lexical(self, query: str, limit: int) -> DataFrame:
        """unit_ix and score of the best units, from the postings of the query's terms alone."""
        from spindrift.operators.lexical import bm25_index

        m = self.manifest()
        ix = F.xxhash64("version_id").alias("unit_ix")
        n, average = m["lexical"]
        return bm25_index(self.table("postings", m).select(ix, "term", "tf"), self.table("lengths", m).select(ix, "len"), query, limit, total=(n, average))

    # publish

    def publish(self, run_id: int, locators: dict[str, str], actions: DataFrame, files: DataFrame, units: DataFrame, representations: DataFrame, references: DataFrame, texts: DataFrame | None = None, settings: dict | None = None, base: int | None = None, fault: Callable[[str], None] = lambda step: None) -> dict:
        """Merge a run over one or more projects into a new generation and make it current; returns the report.

        locators: of each project; actions: project_label, doc_id, seen and action
        of their documents; the other tables hold the upserted documents' new rows;
        texts: version_id and the content that the lexical index is made of (else the
        full_source representations). ``fault`` is called after each step and may
        raise: nothing is visible until the manifest is swapped. A run that is
        already published returns its report again.
        """
        from spindrift.checkpoints import checkpointed
        from spindrift.operators import incremental as inc
        from spindrift.operators import lexical
        from spindrift.operators.usage import usage_channel

        m = self.manifest()
        if m["generation"] == run_id and m["report"]:
            return m["report"]
        if base is not None and base != m["generation"]:
            raise RuntimeError(f"the run started from generation {base}; the current one is {m['generation']}")
        if run_id <= m["generation"]:
            raise ValueError("a run's number must exceed the current generation")
        fault("validate")
        for key in IMMUTABLE:
            old, new = m["settings"].get(key), (settings or {}).get(key)
            if old is not None and new is not None and old != new:
                raise ValueError(f"{key} is {old!r} since the first publish")
        m_settings = m["settings"] | (settings or {})
        fault("settings")
        known = {r.label: r for r in self.table("projects", m).collect()}  # a catalogue
        for project, locator in locators.items():
            if project in known and known[project].locator != locator and self.table("files", m).filter(F.col("project_label") == project).limit(1).count():
                raise ValueError(f"the project {project} is indexed from {known[project].locator}")
        projects = self.spark.createDataFrame([(k, v, run_id) for k, v in locators.items()] + [(k, r.locator, r.last_run_id) for k, r in known.items() if k not in locators], TABLES["projects"])
        fault("projects")
        actions = checkpointed(actions.select("project_label", F.col("doc_id").cast("string").alias("doc_id"), F.col("seen.revision").cast("string").alias("revision"), "action"))
        changed = actions.filter(F.col("action") != "unchanged")
        gone = changed.filter(F.col("action").isin("upsert", "delete")).select("project_label", "doc_id")
        touched = self._touched("files", gone, m)
        t = {name: self.table(name, m, touched) for name in BY_DOCUMENT}
        rest = {name: t[name].join(gone, ["project_label", "doc_id"], "left_anti").select(*t[name].columns) for name in BY_DOCUMENT}
        fault("delete")
        metadata = changed.filter(F.col("action") == "metadata").select("project_label", "doc_id", F.col("revision").alias("__revision"))
        files_touched = touched | self._touched("files", metadata, m)
        old_files = self.table("files", m, files_touched)
        rest["files"] = old_files.join(gone, ["project_label", "doc_id"], "left_anti").join(metadata, ["project_label", "doc_id"], "left").withColumn("revision", F.coalesce("__revision", "revision")).select(*old_files.columns)
        fault("metadata")
        body = representations.filter("kind = 'full_source'").select("version_id", "content") if texts is None else texts
        indexed = units.select("project_label", "doc_id", "version_id", "name", "scope", "relative_path").join(body, "version_id", "left")
        keys = ("version_id", "project_label", "doc_id")
        new = {
            "files": files, "units": units, "representations": representations.filter("kind <> 'usage'"), "references": references,
            "postings": lexical.postings(indexed, keys=keys), "lengths": lexical.doc_stats(indexed, keys=keys),
        }
        merged = {name: rest[name].unionByName(new[name].select(*t[name].columns)) for name in BY_DOCUMENT}
        folders = {name: self._rewritten(name, merged[name], m, run_id, files_touched if name == "files" else touched) for name in BY_DOCUMENT}
        at = lambda name: self._read(name, folders.get(name, m["folders"].get(name, {})))
        fault("insert")
        # call sites of a project name units anywhere in it, so the channel is made anew, of names and lines alone
        numbered = at("units").select(F.xxhash64("version_id").alias("unit_ix"), "version_id", "project_label", "doc_id", "name")
        calls = at("references").select("project_label", F.xxhash64("caller_version").alias("caller_ix"), "callee", "snippet")
        usage = usage_channel(calls, numbered).join(numbered.select("unit_ix", "version_id", "project_label", "doc_id"), "unit_ix")
        folders["usage"] = self._rewritten("usage", usage.withColumn("origin", F.lit("derived")), m, run_id, None)
        fault("usage")
        seen = inc.entity_ledger(at("units").withColumn("generation", F.coalesce("generation", F.lit(run_id))))
        entities = self.table("entities", m)
        old = entities.join(seen.select("entity_id"), "entity_id", "left_semi")
        ledger = old.unionByName(seen.select(*old.columns)).groupBy("entity_id").agg(F.min("first_generation").alias("first_generation"), F.max("last_generation").alias("last_generation"))
        folders["entities"] = self._rewritten("entities", ledger, m, run_id, None)
        fault("orphans")
        keyed = at("units").withColumn("unit_ix", F.xxhash64("version_id"))
        rows = at("representations").unionByName(at("usage")).withColumn("unit_ix", F.xxhash64("version_id"))
        bad = {r.what: r.n for r in inc.dangling_rows(keyed, at("files").select("doc_id").distinct(), rows, at("entities")).collect() if r.n}
        if bad:
            raise RuntimeError(f"the run leaves dangling rows: {bad}")
        fault("dangling")
        counts = {(r.project_label, r.action): r["count"] for r in actions.groupBy("project_label", "action").count().collect()}
        vectors = self.table("vectors", m)
        if any(a in ("upsert", "delete") for _, a in counts) and m["folders"].get("vectors"):
            dead = checkpointed(inc.orphan_vectors(vectors, rows, self.table("spaces", m)))
            hit = self._touched("vectors", dead, m)
            if hit:
                kept = self.table("vectors", m, hit).join(dead, ["space_id", "content_hash"], "left_anti")
                folders["vectors"] = self._rewritten("vectors", kept, m, run_id, hit)
        fault("vectors")
        folders["projects"] = self._rewritten("projects", projects, m, run_id, None)
        size = at("lengths").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("len"), F.lit(0.0)).alias("average")).first()
        total = {r.project_label: r["count"] for r in at("units").groupBy("project_label").count().collect()}
        written = {r.project_label: r["count"] for r in units.groupBy("project_label").count().collect()}
        of = lambda p, *names: sum(counts.get((p, a), 0) for a in names)
        per = {p: {"indexed": of(p, "upsert"), "removed": of(p, "delete"), "skipped": of(p, "unchanged", "metadata"), "units": written.get(p, 0), "total_units": total.get(p, 0)} for p in locators}
        report = {"run": run_id} | {k: sum(x[k] for x in per.values()) for k in ("indexed", "removed", "skipped", "units")} | {"total_units": sum(total.values()), "projects": per}
        fault("manifest")
        self._swap(m | {"generation": run_id, "folders": m["folders"] | folders, "settings": m_settings, "report": report, "lexical": [size.n, size.average]})
        return report

    def remove_project(self, project: str) -> None:
        """Forget a project's name; its documents go by a run that deletes them."""
        have = self.table("projects")
        self.replace(projects=have.filter(F.col("label") != project))

    def collect_garbage(self, older_than_s: float = 3600.0) -> int:
        """Folders that the manifest doesn't name and no reader can still be using; returns how many went."""
        named = {"/".join(p.split("/")[:2]) for own in self.manifest()["folders"].values() for paths in own.values() for p in paths}
        n = 0
        for name in TABLES:
            for folder, written in self.files.list(name):
                if f"{name}/{folder}" not in named and time.time() - written > older_than_s:
                    self.files.delete(f"{name}/{folder}")
                    n += 1
        return n


def envelope(df: DataFrame, event: str, version: int = 1) -> DataFrame:
    """One JSON line for each row: version, event, data."""
    return df.select(F.to_json(F.struct(F.lit(version).alias("version"), F.lit(event).alias("event"), F.struct(*df.columns).alias("data"))).alias("line"))
