"""Directory trees as node tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import base_name, is_hidden, parent_dir


def tree_nodes(files: DataFrame, *, root: str = "", max_depth: int | None = None, include: str | None = None, exclude: str | None = None) -> DataFrame:
    """(path, parent, depth, is_dir): every file and folder below root, hidden ones left out.

    depth counts components below root.  include and exclude are patterns on file paths; folders
    appear if a file in them does.
    """
    path = F.regexp_replace(F.substr(F.col("path"), F.lit(len(root) + 1)), "^/+|/+$", "")
    rows = files.where(F.startswith("path", F.lit(root))).select(path.alias("p")).where((F.length("p") > 0) & ~is_hidden(F.col("p")))
    if include:
        rows = rows.where(F.col("p").rlike(include))
    if exclude:
        rows = rows.where(~F.col("p").rlike(exclude))
    parts = F.split("p", "/")
    levels = F.sequence(F.lit(1), F.size(parts))
    nodes = rows.select(F.explode(F.transform(levels, lambda i: F.struct(F.array_join(F.slice(parts, F.lit(1), i), "/").alias("path"), i.alias("depth"), (i < F.size(parts)).alias("is_dir")))).alias("n"))
    out = nodes.select("n.*").groupBy("path", "depth").agg(F.max("is_dir").alias("is_dir"))
    if max_depth is not None:
        out = out.where(F.col("depth") <= max_depth)
    parent = F.when(F.col("depth") > 1, parent_dir(F.col("path"))).otherwise("")
    return out.select("path", parent.alias("parent"), "depth", "is_dir")


def children(nodes: DataFrame, folder: str) -> DataFrame:
    return nodes.where(F.col("parent") == folder).select(base_name(F.col("path")).alias("name"), "is_dir")


def folder_totals(files: DataFrame) -> DataFrame:
    """(folder, files, bytes) of the files directly in each folder."""
    return files.groupBy(parent_dir(F.col("path")).alias("folder")).agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))
