"""The journal of index runs: their states, owners and staged documents.

Runs are rows of one small JSON file that is replaced in one rename; the documents
of a run are appended as Parquet, the last row of each counts. A run belongs to
the owner that claimed it; every write says who writes and is refused to others,
and a claim takes over a run whose owner hasn't been heard of for ``STALE_S``.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindrift.operators import incremental as inc
from spindrift.plans.index_run import transition
from spindrift.schemas import STAGED
from spindrift.sources.store import Store

PAYLOAD_VERSION = 1
STALE_S = 30.0
TERMINAL = ("committed", "failed", "superseded", "abandoned")


class NotOwner(RuntimeError):
    """Another owner has the run, or it isn't in the state that the write expects."""


class Journal:
    """The runs of a store."""

    def __init__(self, store: Store, clock=time.time):
        self.store, self.clock = store, clock

    # runs

    def _load(self) -> dict:
        return json.loads(self.store.files.read("_runs.json") or '{"next": 1, "runs": []}')

    def _save(self, book: dict) -> None:
        self.store.files.write("_runs.json", json.dumps(book, sort_keys=True))

    def runs(self, limit: int | None = None) -> list[dict]:
        """Newest first."""
        return sorted(self._load()["runs"], key=lambda r: -r["run_id"])[:limit]

    def run(self, run_id: int) -> dict:
        for r in self._load()["runs"]:
            if r["run_id"] == run_id:
                return r
        raise ValueError(f"there is no run {run_id}")

    def create_or_resume(self, scope: list[str], fingerprint: str, resume: bool = True) -> tuple[int, bool]:
        """(run, whether it goes on): the newest run of the same scope, settings, payload and base that can go on, else a new one.

        Open runs whose projects overlap a new one's are superseded.
        """
        book, base, scope = self._load(), self.store.generation, sorted(scope)
        same = [r for r in book["runs"] if r["scope"] == scope and r["fingerprint"] == fingerprint and r["payload_version"] == PAYLOAD_VERSION and r["base"] == base and r["state"] not in TERMINAL]
        if resume and same:
            return max(r["run_id"] for r in same), True
        for r in book["runs"]:
            if r["state"] not in TERMINAL and set(r["scope"]) & set(scope):
                r["state"] = "superseded"
        run_id = max(book["next"], base + 1)
        book["runs"].append({"run_id": run_id, "scope": scope, "fingerprint": fingerprint, "payload_version": PAYLOAD_VERSION, "base": base, "state": "planning", "phase": "planning", "owner": None, "heartbeat": 0.0, "refresh_rounds": 0, "note": None})
        book["next"] = run_id + 1
        self._save(book)
        return run_id, False

    def _change(self, run_id: int, by: str | None, **new) -> dict:
        book = self._load()
        for r in book["runs"]:
            if r["run_id"] == run_id:
                if by is not None and r["owner"] != by:
                    raise NotOwner(f"run {run_id} belongs to {r['owner']}")
                if "state" in new:
                    new["state"] = transition(r["state"], new["state"])
                r |= new
                self._save(book)
                return r
        raise ValueError(f"there is no run {run_id}")

    def claim(self, run_id: int, owner: str | None = None) -> str:
        """Own a run: free, or left by an owner who is stale. What was in work or failed waits again; ready documents count as reused."""
        r, now = self.run(run_id), self.clock()
        if r["state"] in TERMINAL:
            raise NotOwner(f"run {run_id} is {r['state']}")
        owner = owner or uuid.uuid4().hex
        lost = r["owner"] is not None and r["owner"] != owner
        if lost and now - r["heartbeat"] < STALE_S:
            raise NotOwner(f"run {run_id} belongs to {r['owner']}")
        self._change(run_id, None, owner=owner, heartbeat=now, note="process_lost" if lost else r["note"])
        if r["state"] in ("planning", "paused", "ready"):
            self._change(run_id, owner, state="running")
        held = self.documents(run_id)
        again = held.filter("state IN ('processing', 'error')").withColumn("state", F.lit("pending"))
        kept = held.filter("state = 'ready' AND action = 'upsert'").withColumn("reused", F.col("reused") + 1)
        self._append(run_id, again.unionByName(kept))
        return owner

    def heartbeat(self, run_id: int, owner: str) -> None:
        self._change(run_id, owner, heartbeat=self.clock())

    def set_phase(self, run_id: int, owner: str, phase: str) -> None:
        self._change(run_id, owner, phase=phase, heartbeat=self.clock())

    def refreshed(self, run_id: int, owner: str) -> int:
        return self._change(run_id, owner, refresh_rounds=self.run(run_id)["refresh_rounds"] + 1)["refresh_rounds"]

    def ready(self, run_id: int, owner: str) -> None:
        """All documents must be ready."""
        if self.documents(run_id).filter("state <> 'ready'").limit(1).count():
            raise NotOwner(f"run {run_id} has documents that aren't ready")
        self._change(run_id, owner, state="ready")

    def commit(self, run_id: int, owner: str) -> None:
        self._change(run_id, owner, state="committed")

    def pause(self, run_id: int, owner: str, note: str) -> None:
        self._change(run_id, owner, state="paused", owner=None, note=note)

    def fail(self, run_id: int, owner: str, note: str) -> None:
        self._change(run_id, owner, state="failed", note=note)

    def abandon(self, run_id: int) -> None:
        self._change(run_id, None, state="abandoned")

    def supersede(self, run_id: int) -> None:
        self._change(run_id, None, state="superseded")

    def collect(self, keep: int) -> list[int]:
        """Forget the finished runs beyond the newest ``keep``, with their documents."""
        book = self._load()
        done = sorted((r["run_id"] for r in book["runs"] if r["state"] in TERMINAL), reverse=True)[keep:]
        book["runs"] = [r for r in book["runs"] if r["run_id"] not in done]
        self._save(book)
        for run_id in done:
            self.store.files.delete(f"staged/run-{run_id}")
        return done

    # documents

    def _append(self, run_id: int, rows: DataFrame) -> None:
        fields = [c.split()[0] for c in STAGED.split(", ")]
        step = len(self.store.files.list(f"staged/run-{run_id}"))
        rows.select(*fields).withColumn("step", F.lit(step)).write.parquet(f"{self.store.root}/staged/run-{run_id}/s{step:06d}-{uuid.uuid4().hex[:8]}")

    def documents(self, run_id: int) -> DataFrame:
        """The last row of each document of a run, but for those that were dropped from it."""
        spark = self.store.spark
        steps = [s for s, _ in self.store.files.list(f"staged/run-{run_id}") if s.startswith("s")]
        if not steps:
            return spark.createDataFrame([], STAGED)
        rows = spark.read.schema(f"{STAGED}, step int").parquet(*[f"{self.store.root}/staged/run-{run_id}/{s}" for s in steps])
        last = Window.partitionBy("project_label", "doc_id").orderBy(F.desc("step"))
        return rows.withColumn("k", F.row_number().over(last)).filter("k = 1 AND state <> 'dropped'").drop("k", "step")

    def stage(self, run_id: int, owner: str, project: str, observed: DataFrame) -> None:
        """Reconcile the journal with what was observed (doc_id, path, language, fingerprint, action): equal rows keep their state."""
        self.heartbeat(run_id, owner)
        have = self.documents(run_id).filter(F.col("project_label") == project)
        keys = ["path", "language", "action", "fingerprint"]
        now = observed.select("doc_id", *keys)
        both = now.join(have.select("doc_id", *[F.col(c).alias(f"had_{c}") for c in keys], F.col("state").alias("had")), "doc_id", "left")
        same = F.col("had").isNotNull() & (F.col("had") != "processing")
        for c in keys:
            same = same & F.col(c).eqNullSafe(F.col(f"had_{c}"))
        fresh = both.filter(~same).withColumn("state", F.when(F.col("action") == "upsert", "pending").otherwise("ready"))
        row = lambda df: df.select(F.lit(run_id).cast("bigint").alias("run_id"), F.lit(project).alias("project_label"), "doc_id", *keys[:2], "fingerprint", "action", "state", F.lit(0).alias("attempts"), F.lit(0).alias("reused"), F.lit(None).cast("string").alias("error"))
        gone = have.join(now.select("doc_id"), "doc_id", "left_anti").withColumn("state", F.lit("dropped"))
        self._append(run_id, row(fresh).unionByName(gone.select(*[c.split()[0] for c in STAGED.split(", ")])))

    def _move(self, run_id: int, owner: str, ids: DataFrame, before: str, after: str, attempts: int = 0) -> int:
        """Documents (project_label, doc_id, maybe error) go from a state to another; returns how many did."""
        self.heartbeat(run_id, owner)
        at = self.documents(run_id).filter(F.col("state") == before)
        error = F.col("new_error") if "error" in ids.columns else F.lit(None).cast("string")
        named = ids.select("project_label", "doc_id", *([F.col("error").alias("new_error")] if "error" in ids.columns else [])).distinct()
        moved = at.join(named, ["project_label", "doc_id"]).withColumns({"state": F.lit(after), "attempts": F.col("attempts") + attempts, "error": error})
        n = moved.count()
        if n:
            self._append(run_id, moved)
        return n

    def begin(self, run_id: int, owner: str, ids: DataFrame) -> int:
        return self._move(run_id, owner, ids, "pending", "processing", 1)

    def checkpoint(self, run_id: int, owner: str, ids: DataFrame) -> int:
        return self._move(run_id, owner, ids, "processing", "ready")

    def error(self, run_id: int, owner: str, ids: DataFrame) -> int:
        """ids: with the column error."""
        return self._move(run_id, owner, ids, "processing", "error")

    def reset(self, run_id: int, owner: str, ids: DataFrame) -> int:
        return self._move(run_id, owner, ids, "processing", "pending")

    def status(self, run_id: int) -> dict:
        """The run with the counts of its documents."""
        found = inc.run_stats(self.documents(run_id)).collect()
        counts = found[0].asDict() if found else {"documents": 0, "ready": 0, "pending": 0, "errors": 0, "reused": 0, "retried": 0}
        return self.run(run_id) | {k: v for k, v in counts.items() if k != "run_id"}

    def digest(self, run_id: int) -> str:
        """Of the documents to publish, in ranges of their hash."""
        return inc.manifest_digest(self.documents(run_id)).first().digest

    def validate(self, run_id: int, digest: str) -> None:
        """What is published must be what was staged, in this payload version."""
        r = self.run(run_id)
        if r["payload_version"] != PAYLOAD_VERSION:
            raise ValueError(f"run {run_id} has payload version {r['payload_version']}, not {PAYLOAD_VERSION}")
        if self.digest(run_id) != digest:
            raise ValueError(f"run {run_id} has other documents than were staged")
