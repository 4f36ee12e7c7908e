"""Reference queries: who uses the names that are defined in a place."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.params import DEFINITIONS
from ..functions.ranges import contains_lines


def roots_in(elements: DataFrame, path: str, start: int, end: int) -> DataFrame:
    """Definitions of a file that lie within the lines start to end (from 0)."""
    return elements.where((F.col("path") == path) & F.col("element_type").isin(*DEFINITIONS) & contains_lines(F.col("sl"), F.col("el"), F.lit(start), F.lit(end)))


def last_roots(roots: DataFrame) -> DataFrame:
    """Of roots of one name and file the last by ordinal: it receives the references."""
    w = Window.partitionBy("path", "name").orderBy(F.desc("ordinal"))
    return roots.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def references(elements: DataFrame, names: DataFrame) -> DataFrame:
    """Calls and references, in any file and language, of the given names (column ``name``)."""
    uses = elements.where(F.col("element_type").isin("CALL", "REFERENCE"))
    return uses.join(names.select("name").distinct(), "name").select("name", "path", "language", "element_type", "sl", "sc", "el", "ec")


def reference_tree(elements: DataFrame, roots: DataFrame, most: int | None = None) -> DataFrame:
    """Rows (root_path, name, root_sl, path, sl, rank): each root's uses; of equal names in a file only the last root has any.

    The uses of a name are the same for all of its roots: they are ranked once for each name, and
    with ``most`` cut to so many, before they meet the roots.
    """
    last = last_roots(roots).select(F.col("path").alias("root_path"), "name", F.col("sl").alias("root_sl"))
    w = Window.partitionBy("name").orderBy("path", "sl", "sc", "ec")
    ranked = references(elements, last).withColumn("rank", F.row_number().over(w))
    ranked = ranked if most is None else ranked.where(F.col("rank") <= most)
    return ranked.join(last, "name").select("root_path", "name", "root_sl", "path", "sl", "sc", "rank")


def limited(tree: DataFrame, siblings: int, layers: int, longest: int = 200) -> DataFrame:
    """Which nodes of a tree (depth, rank, sl, el) get content: the first siblings of the first layers that aren't too long."""
    return tree.withColumn("has_content", (F.col("rank") <= siblings) & (F.col("depth") <= layers) & (F.col("el") - F.col("sl") <= longest))
