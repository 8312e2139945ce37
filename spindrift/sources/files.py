"""Documents from a folder tree, from memory, or from any DataFrame of that shape.

A source is a DataFrame of doc_id, path, language, revision, content, source_hash,
error. The tree is listed on the driver (ignore files nest, so they are read
top-down); contents are read by Spark.
"""

from __future__ import annotations

import hashlib
import os
import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.operators.filters import glob_regex
from spindrift.operators.incremental import READ_ERROR

LANGUAGES = {
    "c": "c h",
    "cpp": "cc cpp cxx c++ hpp hh hxx h++",
    "csharp": "cs",
    "go": "go",
    "java": "java",
    "javascript": "js jsx mjs cjs",
    "kotlin": "kt kts",
    "php": "php phtml",
    "python": "py",
    "ruby": "rb",
    "rust": "rs",
    "typescript": "ts tsx mts cts",
}
#: Extension to language; the first language in alphabetical order wins.
EXTENSIONS = {ext: lang for lang in sorted(LANGUAGES, reverse=True) for ext in LANGUAGES[lang].split()}

DOCUMENTS = "doc_id string, path string, language string, revision string, content string, source_hash string, error string"


class Ignore:
    """The rules of one ignore file, relative to its folder; the last that fits decides."""

    def __init__(self, text: str):
        self.rules = []
        for line in text.splitlines():
            line = line.rstrip()
            if not line or line.startswith("#"):
                continue
            keep = line.startswith("!")
            line = line.removeprefix("!").removeprefix("\\")
            folder = line.endswith("/")
            line = line.rstrip("/")
            anchored = "/" in line
            glob = line.lstrip("/") if anchored else f"**/{line}"
            self.rules.append((re.compile(glob_regex(glob, True)), keep, folder))

    def verdict(self, path: str, is_dir: bool) -> bool | None:
        """True to ignore, False to keep, None for no rule."""
        out = None
        for pattern, keep, folder in self.rules:
            if (is_dir or not folder) and pattern.match(path):
                out = not keep
        return out


def scan_files(root: str, exclude: list[str] = (), languages: list[str] | None = None) -> list[tuple[str, str]]:
    """(relative path, language) of the files to index, by path: ignore files, hidden names and exclude globs left out."""
    base, banned = Path(root), [re.compile(glob_regex(g, True)) for g in exclude]
    found: list[tuple[str, str]] = []

    def walk(folder: Path, ignores: list[tuple[str, Ignore]]) -> None:
        for name in (".gitignore", ".ignore"):
            if (f := folder / name).is_file():
                ignores = [*ignores, (folder.relative_to(base).as_posix(), Ignore(f.read_text(errors="replace")))]
        for entry in sorted(os.scandir(folder), key=lambda e: e.name):
            if entry.name.startswith("."):
                continue
            rel = Path(entry.path).relative_to(base).as_posix()
            verdict = None
            for at, rules in ignores:
                inner = rel if at == "." else rel[len(at) + 1 :]
                v = rules.verdict(inner, entry.is_dir(follow_symlinks=False))
                verdict = v if v is not None else verdict
            if verdict or any(p.match(rel) for p in banned):
                continue
            if entry.is_dir(follow_symlinks=False):
                walk(Path(entry.path), ignores)
            elif entry.is_file(follow_symlinks=False):
                lang = EXTENSIONS.get(entry.name.rpartition(".")[2]) if "." in entry.name else None
                if lang and (languages is None or lang in languages):
                    found.append((rel, lang))

    walk(base, [])
    return sorted(found)


def file_documents(spark: SparkSession, root: str, exclude: list[str] = (), languages: list[str] | None = None) -> DataFrame:
    """The tree's documents with revision ``mtime_ns:size``; a file that changes while it is read, or goes, has an error."""
    listed = []
    for rel, lang in scan_files(root, exclude, languages):
        st = os.stat(os.path.join(root, rel))
        listed.append((rel, rel, lang, f"{st.st_mtime_ns}:{st.st_size}"))
    rows = spark.createDataFrame(listed, "doc_id string, path string, language string, revision string")

    def read(frames):
        for f in frames:
            out = [stable_read(os.path.join(root, p), r) for p, r in zip(f["path"], f["revision"])]
            f["content"] = [c for c, _ in out]
            f["source_hash"] = [READ_ERROR if e else hashlib.sha256(c.encode()).hexdigest() for c, e in out]
            f["error"] = [e for _, e in out]
            yield f

    n = max(1, min(len(listed), spark.sparkContext.defaultParallelism))
    return rows.repartition(n).mapInPandas(read, DOCUMENTS)


def stable_read(path: str, revision: str) -> tuple[str | None, str | None]:
    """(content, error): read between two looks at the file, which must both show the revision."""
    try:
        look = lambda: (lambda s: f"{s.st_mtime_ns}:{s.st_size}")(os.stat(path))
        if look() != revision:
            return None, "changed"
        raw = Path(path).read_bytes()
        if look() != revision:
            return None, "changed"
        return raw.decode("utf-8"), None
    except FileNotFoundError:
        return None, "changed"
    except UnicodeDecodeError:
        return None, "not UTF-8"
    except OSError as e:
        return None, str(e)


def binary_documents(spark: SparkSession, root: str, exclude: list[str] = ()) -> DataFrame:
    """The same for trees too large for one listing: Spark lists and reads, exclude globs apply, ignore files don't."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    rel = F.regexp_replace("path", "^.*?" + re.escape(os.path.abspath(root)) + "/", "")
    ext = F.substring_index("path", ".", -1)
    lang = F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])
    text = F.when(F.is_valid_utf8("content"), F.decode("content", "UTF-8"))
    out = files.select(rel.alias("path"), lang[ext].alias("language"), F.concat_ws(":", F.unix_micros("modificationTime"), "length").alias("revision"), text.alias("content")).filter("language IS NOT NULL")
    for g in exclude:
        out = out.filter(~F.col("path").rlike(glob_regex(g, True)))
    error = F.when(F.col("content").isNull(), "not UTF-8")
    return out.select(F.col("path").alias("doc_id"), "path", "language", "revision", "content", F.coalesce(F.sha2("content", 256), F.lit(READ_ERROR)).alias("source_hash"), error.alias("error"))


def memory_documents(spark: SparkSession, texts: dict[str, str]) -> DataFrame:
    """Path to text; the revision is the text's hash and may be trusted."""
    rows = [(p, p, EXTENSIONS.get(p.rpartition(".")[2]), h, t, h, None) for p, t in texts.items() for h in [hashlib.sha256(t.encode()).hexdigest()]]
    return spark.createDataFrame(rows, DOCUMENTS)


def recover(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (doc_id, path) with the content found by id, else by path."""
    by_id = documents.select("doc_id", F.col("content").alias("c1"))
    by_path = documents.select("path", F.col("content").alias("c2"))
    return wanted.join(by_id, "doc_id", "left").join(by_path, "path", "left").select("doc_id", "path", F.coalesce("c1", "c2").alias("content"))
