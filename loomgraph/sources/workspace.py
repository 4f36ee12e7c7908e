"""Files of a workspace, its projects and modules."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import LANGUAGES, base_name, is_hidden, parent_dir
from ..session import checkpoint_folder
from .ignore import MAX_BYTES, ignored, rejected

MAX_FILES = 10_000


def listing(spark: SparkSession, root: str, pattern: str = "*", *, rules: list[str] | None = None, most: int | None = None) -> DataFrame:
    """(path relative to root, modified, size) of all files below root, hidden ones left out; contents aren't read.

    The walk goes down level by level, each folder listed by a task; hidden folders, and those
    that the ignore rules leave out, are never entered.  Names that begin with "_" are names like
    others.  It ends once ``most`` entries (None: any number) have been visited, with what it has
    by then.  root is a path or URI that all machines can read.
    """
    found, level, visited = None, spark.createDataFrame([("",)], "folder string"), 0
    top = root.rstrip("/") or "/"
    while True:
        entries = level.repartition(max(1, min(spark.sparkContext.defaultParallelism, level.count()))).mapInArrow(partial(_entries, top), "path string, folder boolean, modified timestamp, size long")
        entries = _stored(entries.where(~is_hidden(F.col("path"))))
        visited += entries.count()
        found = entries if found is None else found.unionByName(entries)
        down = entries.where("folder")
        if rules:
            down = down.where(~ignored(F.concat("path", F.lit("/")), rules))
        level = down.select(F.col("path").alias("folder"))
        if level.isEmpty() or (most is not None and visited >= most):
            break
    glob = "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "$"
    return found.where(~F.col("folder") & base_name(F.col("path")).rlike(glob)).select("path", "modified", "size")


def contents(spark: SparkSession, root: str, pattern: str = "*", *, rules: list[str] | None = None) -> DataFrame:
    """(path relative to root, modified, size, content as text) of the files that ``listing`` gives; bytes that are no UTF-8 are replaced."""
    return listing(spark, root, pattern, rules=rules).mapInArrow(partial(_texts, root.rstrip("/") or "/"), "path string, modified timestamp, size long, content string")


def _stored(df: DataFrame) -> DataFrame:
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def _entries(root: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Folders (relative to root) to their entries."""
    store, top = pafs.FileSystem.from_uri(root)
    for batch in batches:
        rows = []
        for folder in batch.column("folder").to_pylist():
            for x in store.get_file_info(pafs.FileSelector(f"{top}/{folder}" if folder else top, allow_not_found=True)):
                rows.append((f"{folder}/{x.base_name}" if folder else x.base_name, x.type == pafs.FileType.Directory, x.mtime, x.size))
        kinds = (pa.string(), pa.bool_(), pa.timestamp("us", "UTC"), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=["path", "folder", "modified", "size"])


def _texts(root: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a listing with their files' contents, a few files at a time."""
    store, top = pafs.FileSystem.from_uri(root)
    for batch in batches:
        for start in range(0, batch.num_rows, 64):
            part = batch.slice(start, 64)
            texts = [store.open_input_stream(f"{top}/{p}").read().decode("utf-8", "replace") for p in part.column("path").to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, "content"])


def accepted(files: DataFrame, rules: list[str], *, extensions: tuple[str, ...] = tuple(LANGUAGES), most_bytes: int = MAX_BYTES, most_files: int | None = None) -> DataFrame:
    """Files that are indexed, with ts in seconds; with ``most_files`` (MAX_FILES for a small machine), so many in order of path."""
    kept = files.where(~rejected(F.col("path"), F.col("size"), rules, extensions, most=most_bytes, inclusive=True))
    kept = kept.select("path", "size", F.unix_seconds("modified").alias("ts"))
    return kept if most_files is None else kept.orderBy("path").limit(most_files)


def hash_tree(files: DataFrame, codebase: Column | str = "") -> DataFrame:
    """(codebase_id, path, hash): the modification time in milliseconds, as text."""
    return files.select((F.lit(codebase) if isinstance(codebase, str) else codebase).alias("codebase_id"), "path", F.unix_millis("modified").cast("string").alias("hash"))


def scan_paths(files: DataFrame, paths: DataFrame, rules: list[str], *, extensions: tuple[str, ...] = tuple(LANGUAGES), most_bytes: int = MAX_BYTES) -> DataFrame:
    """The listed files, and the files below listed folders, that are indexed: path and modified.

    files: a listing (path, modified, size).  Each file is expanded into its folders, which are
    matched with the list by equality.
    """
    wanted = paths.select(F.regexp_replace("path", "/+$", "").alias("asked")).distinct()
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    hits = files.select("path", F.explode(above).alias("asked")).join(wanted, "asked", "left_semi").select("path").distinct()
    kept = files.where(~rejected(F.col("path"), F.col("size"), rules, extensions, most=most_bytes, inclusive=True))
    return kept.join(hits, "path", "left_semi").select("path", "modified")


def with_content_hash(files: DataFrame) -> DataFrame:
    """files (with content) and the SHA-256 of their UTF-8 contents, in hex."""
    return files.withColumn("sha256", F.sha2(F.col("content").cast("binary"), 256))


def manifest(changes: DataFrame, codebase: Column | str, size: int = 100_000) -> DataFrame:
    """(part, metadata): what goes with an upload, as JSON: every change's path and status; parts of about ``size`` changes.

    Changes are dealt to the parts by hash, so that no list grows with the workspace; together the
    parts list each change once, one of a null or repeated path too.
    """
    n = changes.count()
    parts = max(1, -(-n // size))
    rows = changes.withColumn("part", F.pmod(F.xxhash64(*changes.columns), F.lit(parts)).cast("int"))
    listed = F.array_sort(F.collect_list(F.struct("path", "status")))
    name = F.lit(codebase) if isinstance(codebase, str) else codebase
    dealt = rows.repartition(parts, "part")  # a task holds a few parts' lists, whatever their number
    return dealt.groupBy("part").agg(listed.alias("files")).select("part", F.to_json(F.struct(name.alias("codebase"), F.col("files").alias("files"))).alias("metadata"))


def manifest_files(parts: DataFrame) -> DataFrame:
    """(part, path, status): every change that the parts of a manifest list, read from their JSON."""
    listed = F.from_json("metadata", "codebase string, files array<struct<path string, status string>>")["files"]
    return parts.select("part", F.inline(listed))


def projects(paths: DataFrame, workspace: str, depth: int = 3) -> DataFrame:
    """(root) of each project: folders with a .git entry, at most ``depth`` levels down, none inside another; else the workspace.

    paths: all entries (hidden ones too), relative to the workspace.
    """
    marked = paths.where(F.col("path").rlike("(^|/)\\.git(/|$)"))
    roots = marked.select(F.regexp_replace("path", "(^|/)\\.git(/.*)?$", "").alias("root")).distinct()
    roots = roots.where((F.col("root") == "") | (F.size(F.split("root", "/")) <= depth))
    outer = roots.select(F.col("root").alias("outer"))
    inside = (F.col("outer") != F.col("root")) & ((F.col("outer") == "") | F.startswith("root", F.concat("outer", F.lit("/"))))
    top = roots.join(outer, inside, "left_anti")
    found = top.select(F.when(F.col("root") == "", F.lit(workspace)).otherwise(F.concat(F.lit(workspace.rstrip("/") + "/"), F.col("root"))).alias("root"))
    whole = paths.sparkSession.range(1).select(F.lit(workspace).alias("root"))
    return found.unionByName(whole.join(found.select(F.lit(1).alias("one")).limit(1), F.lit(True), "left_anti"))


def go_modules(files: DataFrame) -> DataFrame:
    """(folder, module) of every go.mod among files (path, content), (a module that a go.work names has one of its own)."""
    mods = files.where(F.col("path").rlike("(^|/)go\\.mod$"))
    module = F.regexp_extract("content", "(?m)^\\s*module\\s+\"?([^\\s\"]+)", 1)
    folder = F.when(F.contains("path", F.lit("/")), parent_dir(F.col("path"))).otherwise("")
    return mods.select(folder.alias("folder"), module.alias("module")).where("module <> ''").distinct()
