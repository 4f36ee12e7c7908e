"""The index as tables, and its changes as functions from an old snapshot to a new one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.params import DEFINITIONS
from ..functions.paths import infer_language, with_separator


def symbol_occurrences(elements: DataFrame) -> DataFrame:
    """One row for each definition: the flat symbol table."""
    return elements.where(F.col("element_type").isin(*DEFINITIONS)).select("language", "name", "path", "sl", "sc", "el", "ec", "element_type")


def symbol_table(elements: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """One row for each (language, name), or for those in ``names`` alone, with the sorted list of its occurrences.

    A name's list is as long as it has occurrences; ``symbol_occurrences`` has them as flat rows.
    """
    occurrence = F.struct("path", "sl", "sc", "el", "ec", "element_type")
    flat = symbol_occurrences(elements)
    if names is not None:
        flat = flat.join(names.select("language", "name").distinct(), ["language", "name"], "left_semi")
    return flat.groupBy("language", "name").agg(F.array_sort(F.collect_list(occurrence)).alias("occurrences"))


def changed_files(files: DataFrame, index: DataFrame) -> DataFrame:
    """Files whose (path, ts) the index doesn't have: equal times alone count as unchanged."""
    return files.join(index.select("path", "ts"), ["path", "ts"], "left_anti").select(files.columns)


def upsert(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """old with the rows of new in place of those of equal keys; of equal keys in new, any one row per key is expected."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").select(old.columns).unionByName(new)


def _among(path: Column, targets: list[str]) -> Column:
    out = F.lit(False)
    for t in targets:
        out = out | (path == t) | F.startswith(path, with_separator(F.lit(t)))
    return out


def lookup(files: DataFrame, target: str) -> DataFrame:
    """The file at target, or, if there is none, all files below it."""
    exact = files.where(F.col("path") == target)
    below = files.where(F.startswith(F.col("path"), with_separator(F.lit(target))))
    return exact.unionByName(below.join(exact.select(F.lit(1).alias("found")).limit(1), F.lit(True), "left_anti"))


def remove_paths(table: DataFrame, targets: list[str]) -> DataFrame:
    """The table without rows of these files and of files below these folders; null paths stay."""
    return table.where(~F.coalesce(_among(F.col("path"), targets), F.lit(False)))


def remove_files(table: DataFrame, gone: DataFrame) -> DataFrame:
    """The table without rows of the paths in gone, however many they are."""
    return table.join(gone.select("path").distinct(), "path", "left_anti").select(table.columns)


def rename_paths(table: DataFrame, source: str, target: str) -> DataFrame:
    """Rows of the file or folder source under target, with the language inferred anew."""
    moves = (F.col("path") == source) | F.startswith(F.col("path"), with_separator(F.lit(source)))
    path = F.when(moves, F.concat(F.lit(target), F.substr(F.col("path"), F.lit(len(source) + 1)))).otherwise(F.col("path"))
    out = table.withColumns({"moves": moves, "path": path})
    if "language" not in table.columns:
        return out.drop("moves")
    return out.withColumn("language", F.when(F.col("moves"), F.coalesce(infer_language(F.col("path")), F.col("language"))).otherwise(F.col("language"))).drop("moves")


def reindexed(old: DataFrame, new: DataFrame) -> DataFrame:
    """Index rows after files were indexed again: all old rows of their paths go, the new ones come."""
    return old.join(new.select("path").distinct(), "path", "left_anti").select(old.columns).unionByName(new)


def replaced_occurrences(old: DataFrame, new: DataFrame) -> DataFrame:
    """Occurrences after further ones were found: a new one takes the place of an old one of equal language, name, path and range."""
    keys = ["language", "name", "path", "sl", "sc", "el", "ec"]
    return old.join(new.select(*keys).distinct(), keys, "left_anti").select(old.columns).unionByName(new)


def remaining_symbols(symbols: DataFrame, gone: DataFrame) -> DataFrame:
    """The symbol table (language, name, occurrences) without the occurrences in the files of gone; a symbol without any goes.

    Occurrences are taken apart, joined by path and folded again: no list of files meets a row.
    """
    flat = symbols.select("language", "name", F.explode("occurrences").alias("o")).withColumn("path", F.col("o.path"))
    kept = flat.join(gone.select("path").distinct(), "path", "left_anti")
    return kept.groupBy("language", "name").agg(F.array_sort(F.collect_list("o")).alias("occurrences"))


def count_prefix(table: DataFrame, key: str, prefix: str = "") -> DataFrame:
    """One row, n: rows whose key begins with the prefix; all rows for an empty one."""
    return table.where(F.startswith(F.col(key), F.lit(prefix)) if prefix else F.lit(True)).agg(F.count(F.lit(1)).alias("n"))


def index_summary(files: DataFrame, projects: DataFrame) -> DataFrame:
    """Files of each project, and "success" or "pending"."""
    counted = projects.join(files.groupBy("project").agg(F.count(F.lit(1)).alias("n")), "project", "left")
    return counted.select("project", F.coalesce("n", F.lit(0)).cast("long").alias("total_files"), F.when(F.coalesce("n", F.lit(0)) > 0, "success").otherwise("pending").alias("status"))


def export_rows(symbols: DataFrame) -> DataFrame:
    """One JSON text for each row, for a text sink."""
    return symbols.select(F.to_json(F.struct(*symbols.columns)).alias("value"))
