"""Programs that build an index and carry it through the events of the queue.

An index is a pair of tables: ``files`` (path, ts, further columns) and ``elements`` (path,
language and further columns).  Each program returns new tables; nothing is changed in place.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import infer_language
from ..sources.extract import extract_elements
from . import elements as E
from . import index as I


class Index(NamedTuple):
    files: DataFrame
    elements: DataFrame


#: From rows path, content to rows of elements.
Extractor = Callable[[DataFrame], DataFrame]


def _built(files: DataFrame, extract: Extractor) -> DataFrame:
    return extract(files.select("path", "content")).where(E.is_valid())


def index_workspace(files: DataFrame, old: Index | None = None, *, extract: Extractor = extract_elements) -> Index:
    """The index of a workspace's files (path, ts, content): unchanged files (equal path and ts) keep their old rows.

    Files that are gone leave the index.  Without an old index all files are read.
    """
    if old is None:
        return Index(files.select("path", "ts"), _built(files, extract))
    changed = I.changed_files(files, old.files)
    fresh = _built(changed, extract)
    stays = old.elements.join(files.join(changed.select("path"), "path", "left_anti").select("path").distinct(), "path", "left_semi").select(old.elements.columns)
    return Index(files.select("path", "ts"), stays.unionByName(fresh, allowMissingColumns=True))


def index_files(old: Index, files: DataFrame, wanted: DataFrame, projects: DataFrame, *, extract: Extractor = extract_elements) -> Index:
    """The index after some files (wanted: path) were indexed again, whatever their times.

    A project (projects: root) that has no file in the index yet is indexed as a whole instead.
    """
    roots = of_projects(files.select("path"), projects)
    empty = projects.select("root").distinct().join(of_projects(old.files.select("path"), projects).select("root").distinct(), "root", "left_anti")
    asked = roots.join(wanted.select("path").distinct(), "path", "left_semi")
    first = roots.join(asked.select("root").distinct().join(empty, "root", "left_semi"), "root", "left_semi")
    again = asked.select("path").unionByName(first.select("path")).distinct()
    return upserted(old, files.join(again, "path", "left_semi").select(files.columns), extract=extract)


def upserted(old: Index, files: DataFrame, *, extract: Extractor = extract_elements) -> Index:
    """The index with the rows of these files (path, ts, content) in place of the old ones."""
    fresh = files.select("path", "ts")
    kept = old.elements.join(fresh.select("path").distinct(), "path", "left_anti").select(old.elements.columns)
    return Index(I.upsert(old.files.select("path", "ts"), fresh, "path"), kept.unionByName(_built(files, extract), allowMissingColumns=True))


def of_projects(paths: DataFrame, projects: DataFrame, *, one: bool = False, longest: bool = False) -> DataFrame:
    """(path, root) of every project root above a path, or, with ``one``, of the first by name, with ``longest`` of the innermost.

    Paths are expanded into their folders, which are matched by equality: no path meets all roots.
    """
    parts = F.split("path", "/")
    folders = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    above = paths.select("path").distinct().select("path", F.explode(F.when(F.size(parts) > 1, folders)).alias("root"))
    found = above.join(projects.select("root").distinct(), "root", "left_semi").select("path", "root")
    if longest:
        return found.groupBy("path").agg(F.max_by("root", F.length("root")).alias("root"))
    return found.groupBy("path").agg(F.min("root").alias("root")) if one else found


def removed(old: Index, gone: DataFrame) -> Index:
    """The index without the files in gone (path) and without all files below a folder in gone."""
    below = of_projects(old.files.select("path"), gone.select(F.regexp_replace("path", "/+$", "").alias("root"))).select("path")
    paths = gone.select("path").unionByName(below).distinct()
    return Index(I.remove_files(old.files, paths), I.remove_files(old.elements, paths))


def removed_counts(old: Index, new: Index, workspaces: DataFrame, workspace_of: Callable[[Column], Column]) -> DataFrame:
    """workspaces with file_num less the files that the new index doesn't have any more, not below 0."""
    gone = old.files.select("path").join(new.files.select("path"), "path", "left_anti").groupBy(workspace_of(F.col("path")).alias("workspace")).agg(F.count(F.lit(1)).alias("gone"))
    joined = workspaces.join(gone, "workspace", "left")
    left = F.greatest(F.lit(0), F.col("file_num") - F.coalesce("gone", F.lit(0))).cast(workspaces.schema["file_num"].dataType)
    return joined.withColumn("file_num", left).select(workspaces.columns)


def renamed(old: Index, moves: DataFrame) -> Index:
    """The index after moves (path, target) of files or folders; of several that hold a file the longest path wins.

    Rows of files that a move lands on are replaced; the language follows the new ending.
    """
    roots = moves.select(F.regexp_replace("path", "/+$", "").alias("root"), F.regexp_replace("target", "/+$", "").alias("target")).dropDuplicates(["root"])
    paths = old.files.select("path")
    inside = of_projects(paths, roots.select("root")).unionByName(paths.join(roots.select(F.col("root").alias("path")), "path", "left_semi").select("path", F.col("path").alias("root")))
    best = inside.groupBy("path").agg(F.max_by("root", F.length("root")).alias("root")).join(roots, "root")
    to = best.select("path", F.concat("target", F.substr(F.col("path"), F.length("root") + 1)).alias("new_path"))
    covered = to.select(F.col("new_path").alias("path")).join(to.select("path"), "path", "left_anti").distinct()

    def moved(table: DataFrame) -> DataFrame:
        rest = table.join(covered, "path", "left_anti").join(to, "path", "left")
        path = F.coalesce("new_path", "path")
        language = F.when(F.col("new_path").isNotNull(), F.coalesce(infer_language(F.col("new_path")), F.col("language"))).otherwise(F.col("language")) if "language" in table.columns else None
        return rest.select(*[path.alias(c) if c == "path" else language.alias(c) if c == "language" else F.col(c) for c in table.columns])

    return Index(moved(old.files), moved(old.elements))


def applied(old: Index, events: DataFrame, files: DataFrame, *, extract: Extractor = extract_elements) -> Index:
    """The index after a poll's events (event_type, path, target), in their fixed order of types.

    rebuild_workspace drops the whole index; open_workspace then indexes all files anew, as does a
    rebuild; add_file and modify_file index their files again; delete_file removes files or
    folders; rename_file moves them.  Files that can't be read any more are left out.
    """
    kinds = {r["event_type"] for r in events.select("event_type").distinct().collect()}  # six at most
    of = lambda *names: events.where(F.col("event_type").isin(*names))
    now = old
    if "rebuild_workspace" in kinds:
        now = Index(old.files.limit(0), old.elements.limit(0))
    if kinds & {"rebuild_workspace", "open_workspace"}:
        now = index_workspace(files, now, extract=extract)
    if kinds & {"add_file", "modify_file"}:
        now = upserted(now, files.join(of("add_file", "modify_file").select("path").distinct(), "path", "left_semi").select(files.columns), extract=extract)
    if "delete_file" in kinds:
        now = removed(now, of("delete_file").select("path"))
    if "rename_file" in kinds:
        now = renamed(now, of("rename_file").select("path", "target"))
    return now


def task_metrics(old: Index | None, new: Index, files: DataFrame) -> DataFrame:
    """One row for an index run: files of the workspace, files indexed, symbols and variables stored."""
    total = files.agg(F.count(F.lit(1)).alias("total_files"))
    stored = new.elements.agg(F.countDistinct("path").alias("indexed_files"), F.count_if("is_definition").alias("symbols"), F.count_if(F.col("element_type") == "VARIABLE").alias("variables"))
    return total.crossJoin(stored)  # one row each
