"""Reading a generation: listings in their orders, the snapshot, and an index checked against its spaces.

``tables`` is a mapping of names to DataFrames, such as ``Store.snapshot()`` gives
or any of the same columns.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.functions.vectors import is_finite
from spindrift.operators.incremental import orphan_vectors
from spindrift.operators.ranking import order_snapshot
from spindrift.schemas import REPRESENTATION_ORDER

Tables = Mapping[str, DataFrame]


def list_files(tables: Tables, project: str) -> DataFrame:
    return tables["files"].filter(F.col("project_label") == project).orderBy("path")


def file_by_id(tables: Tables, project: str, doc_id: str) -> DataFrame:
    return tables["files"].filter((F.col("project_label") == project) & (F.col("doc_id") == doc_id))


def units_with_files(tables: Tables) -> DataFrame:
    """Units with their file's path and their project; units without either have no row."""
    files = tables["files"].select("project_label", "doc_id", "path")
    projects = tables["projects"].select(F.col("label").alias("project_label"), "locator")
    return tables["units"].join(files, ["project_label", "doc_id"]).join(projects, "project_label")


def units_of_file(tables: Tables, project: str, doc_id: str) -> DataFrame:
    """By position in the file."""
    own = tables["units"].filter((F.col("project_label") == project) & (F.col("doc_id") == doc_id))
    return own.orderBy("start_byte", "end_byte")


def units_of_project(tables: Tables, project: str) -> DataFrame:
    """By file and position."""
    return units_with_files(tables).filter(F.col("project_label") == project).orderBy("path", "start_byte", "end_byte")


def references_of_file(tables: Tables, project: str, doc_id: str) -> DataFrame:
    """Call sites by line, then caller."""
    own = tables["references"].filter((F.col("project_label") == project) & (F.col("doc_id") == doc_id))
    return own.orderBy("line", "caller_version", "callee")


def _rank(kind) -> Column:
    place = F.array_position(F.array(*[F.lit(k) for k in REPRESENTATION_ORDER]), kind)
    return F.when(place == 0, len(REPRESENTATION_ORDER) + 1).otherwise(place)


def attach_representations(units: DataFrame, representations: DataFrame, key: str = "version_id") -> DataFrame:
    """The units with an array of their representations in the fixed order of kinds, others by name."""
    row = F.struct(_rank(F.col("kind")).alias("rank"), "kind", "content_hash", "content", "origin")
    rows = representations.groupBy(key).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    strip = F.transform("rows", lambda x: F.struct(x["kind"].alias("kind"), x["content_hash"].alias("content_hash"), x["content"].alias("content"), x["origin"].alias("origin")))
    own = rows.select(key, strip.alias("representations"))
    return units.join(own, key, "left").withColumn("representations", F.coalesce("representations", F.array().cast("array<struct<kind:string,content_hash:string,content:string,origin:string>>")))


def snapshot(tables: Tables, spaces: list[str] | None = None, key: str = "version_id") -> dict[str, DataFrame]:
    """units in order with their representations, the selected spaces, and the vectors that selected units refer to."""
    found = units_with_files(tables).drop("unit_ix").withColumn("relative_path", F.col("path")).drop("path")
    units = order_snapshot(attach_representations(found, tables["representations"], key))
    chosen = tables["spaces"] if spaces is None else tables["spaces"].filter(F.col("space_id").isin(list(spaces)))
    vectors = tables["vectors"].join(F.broadcast(chosen.select("space_id")), "space_id")  # spaces are a catalogue
    return {"units": units, "spaces": chosen.orderBy("space_id"), "vectors": referenced_vectors(vectors, tables["representations"], chosen), "relations": tables["relations"]}


def referenced_vectors(vectors: DataFrame, representations: DataFrame, spaces: DataFrame) -> DataFrame:
    """Vectors whose (channel, hash) a representation has."""
    live = representations.select(F.col("kind").alias("channel"), "content_hash").distinct()
    return vectors.join(F.broadcast(spaces.select("space_id", "channel")), "space_id").join(live, ["channel", "content_hash"], "left_semi").select(*vectors.columns)


def spaces_with_models(tables: Tables) -> DataFrame:
    """Spaces joined to their model, by id."""
    models = tables["models"]
    return tables["spaces"].join(F.broadcast(models), F.col("model") == F.col("model_id")).orderBy("space_id")


def space(tables: Tables, space_id: str):
    """One space, or an error that names those there are."""
    rows = {r.space_id: r for r in tables["spaces"].collect()}  # a catalogue
    if space_id not in rows:
        raise ValueError(f"there is no space {space_id}; there are {', '.join(sorted(rows)) or 'none'}")
    return rows[space_id]


def effective_dimensions(row) -> int:
    """The width of a space's stored vectors: projected, else native."""
    return row.output_dimensions or row.dimensions


def embeddings_of_space(tables: Tables, space_id: str) -> DataFrame:
    """A space's vectors by hash."""
    return tables["vectors"].filter(F.col("space_id") == space_id).orderBy("content_hash")


def count_embeddings(tables: Tables) -> DataFrame:
    """space_id and vectors of every space, those without any too."""
    counts = tables["vectors"].groupBy("space_id").agg(F.count(F.lit(1)).alias("vectors"))
    return tables["spaces"].select("space_id").join(counts, "space_id", "left").select("space_id", F.coalesce("vectors", F.lit(0)).alias("vectors"))


def pending_counts(tables: Tables) -> DataFrame:
    """space_id and pending: distinct hashes of the space's channel that have no vector in it."""
    spaces = F.broadcast(tables["spaces"].select("space_id", F.col("channel").alias("kind")))
    wanted = tables["representations"].select("kind", "content_hash").distinct().join(spaces, "kind")
    missing = wanted.join(tables["vectors"].select("space_id", "content_hash"), ["space_id", "content_hash"], "left_anti")
    counts = missing.groupBy("space_id").agg(F.count(F.lit(1)).alias("pending"))
    return tables["spaces"].select("space_id").join(counts, "space_id", "left").select("space_id", F.coalesce("pending", F.lit(0)).alias("pending"))


def embedding_totals(tables: Tables) -> DataFrame:
    """One row: spaces, vectors and pending hashes over all of them."""
    both = count_embeddings(tables).join(pending_counts(tables), "space_id")
    return both.agg(F.count(F.lit(1)).alias("spaces"), F.coalesce(F.sum("vectors"), F.lit(0)).alias("vectors"), F.coalesce(F.sum("pending"), F.lit(0)).alias("pending"))


def list_projects(tables: Tables) -> DataFrame:
    """Projects by label with their units."""
    counts = tables["units"].groupBy("project_label").agg(F.count(F.lit(1)).alias("units"))
    known = tables["projects"].join(counts, F.col("label") == F.col("project_label"), "left")
    return known.select("label", "locator", "last_run_id", F.coalesce("units", F.lit(0)).alias("units")).orderBy("label")


def index_of_space(tables: Tables, space_id: str) -> DataFrame:
    """unit_ix, version_id and embedding (null for none): a space's vectors aligned to the units of a snapshot.

    Raises where a vector has another width than the space or a value that isn't
    finite, a unit has two representations of the space's channel, or a key is
    there twice.
    """
    row = space(tables, space_id)
    width = effective_dimensions(row)
    own = tables["vectors"].filter(F.col("space_id") == space_id)
    bad = own.groupBy("content_hash").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.size("embedding") != width).alias("w"), F.count_if(~is_finite("embedding")).alias("f"))
    bad = bad.agg(F.count_if(F.col("n") > 1).alias("n"), F.sum("w").alias("w"), F.sum("f").alias("f")).first()
    for n, what in ((bad.n, "hashes with several vectors"), (bad.w, f"vectors that aren't {width} wide"), (bad.f, "vectors with values that aren't finite")):
        if n:
            raise ValueError(f"space {space_id} has {n} {what}")
    channel = tables["representations"].filter(F.col("kind") == row.channel).select("version_id", "content_hash")
    if channel.groupBy("version_id").count().filter("count > 1").limit(1).count():
        raise ValueError(f"a unit has several representations of {row.channel}")
    units = tables["units"].select(F.xxhash64("version_id").alias("unit_ix"), "version_id")
    return units.join(channel, "version_id", "left").join(own.select("content_hash", "embedding"), "content_hash", "left").select("unit_ix", "version_id", "embedding")


def orphans(tables: Tables) -> DataFrame:
    return orphan_vectors(tables["vectors"], tables["representations"], tables["spaces"])
