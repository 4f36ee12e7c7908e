"""Rows of the element table: which are valid or kept, and where they lie."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.params import valid_name

#: Workspaces of more files keep no variables at all.
VARIABLE_FILES = 9_000
#: Kinds of stored elements; scopes that are seen outside of a block or function.
KINDS = ("FUNCTION", "METHOD", "CALL", "REFERENCE", "CLASS", "INTERFACE", "VARIABLE", "IMPORT", "PACKAGE")
OUTER_SCOPES = ("package", "file", "project")
LOCAL_SCOPES = ("block", "function")


def is_valid() -> Column:
    """A row can be stored: a known kind, a path, a whole range, and an identifier for a name (imports and packages are exempt)."""
    named = F.col("element_type").isin("IMPORT", "PACKAGE") | valid_name(F.coalesce("name", F.lit("")))
    placed = F.col("sl").isNotNull() & F.col("sc").isNotNull() & F.col("el").isNotNull() & F.col("ec").isNotNull()
    return F.coalesce(named & F.col("element_type").isin(*KINDS) & (F.coalesce("path", F.lit("")) != "") & placed, F.lit(False))


def skips_variable(total_files: Column, scope: Column) -> Column:
    """A row isn't kept: it is a variable that is only seen in its block, function or class, or there are too many files for any."""
    local = ~F.coalesce(scope.isin(*OUTER_SCOPES), F.lit(False))
    return (F.col("element_type") == "VARIABLE") & ((total_files > VARIABLE_FILES) | local)


def checked(elements: DataFrame) -> DataFrame:
    """The valid rows without the variables of blocks and functions."""
    local = (F.col("element_type") == "VARIABLE") & F.coalesce(F.col("scope").isin(*LOCAL_SCOPES), F.lit(False))
    return elements.where(is_valid() & ~local)


def first_at_line(elements: DataFrame, asked: DataFrame) -> DataFrame:
    """Of each asked (path, line) the element of the least ordinal that begins there; none gives no row.

    One row for each of ``asked``'s distinct rows; combined before the shuffle, by equal path and line.
    """
    wanted = asked.select(F.col("path").alias("path_"), F.col("line")).distinct()
    columns = [c for c in elements.columns if c not in ("path", "ordinal")]
    found = elements.join(wanted, (F.col("path") == F.col("path_")) & (F.col("sl") == F.col("line")))
    best = found.groupBy("path", "line").agg(F.min(F.struct("ordinal", *columns)).alias("e"))
    return best.select("path", "line", F.col("e.ordinal").alias("ordinal"), *[F.col(f"e.{c}").alias(c) for c in columns])


def enclosing(elements: DataFrame, uses: DataFrame) -> DataFrame:
    """(path, ordinal, inside): for each use the ordinal of the first definition that begins before its line and ends after it.

    An equi-join on the file with the lines as a residual condition, as files are small; uses
    outside of all definitions have no row.
    """
    around = elements.where("is_definition").select(F.col("path").alias("path_"), F.col("ordinal").alias("ordinal_"), F.col("sl").alias("sl_"), F.col("el").alias("el_"))
    inside = (F.col("path") == F.col("path_")) & (F.col("sl_") < F.col("sl")) & (F.col("sl") < F.col("el_"))
    return uses.join(around, inside).groupBy("path", "ordinal").agg(F.min("ordinal_").alias("inside"))


def of_files(elements: DataFrame, files: DataFrame) -> DataFrame:
    """The elements of the listed paths."""
    return elements.join(files.select("path").distinct(), "path", "left_semi").select(elements.columns)


def named(symbols: DataFrame, names: DataFrame) -> DataFrame:
    """The symbols of the listed (language, name)."""
    return symbols.join(names.select("language", "name").distinct(), ["language", "name"], "left_semi").select(symbols.columns)


def missing(table: DataFrame, asked: DataFrame, *keys: str) -> DataFrame:
    """The asked keys that the table doesn't have."""
    return asked.select(*keys).distinct().join(table.select(*keys), list(keys), "left_anti")


def accuracy(found: DataFrame, expected: DataFrame, *keys: str) -> DataFrame:
    """One row, total, correct, percent: how many of the expected rows were found."""
    hit = expected.distinct().join(found.select(*keys).distinct().withColumn("hit", F.lit(1)), list(keys), "left")
    counted = hit.agg(F.count(F.lit(1)).alias("total"), F.count("hit").alias("correct"))
    return counted.withColumn("percent", F.when(F.col("total") > 0, F.round(F.col("correct") / F.col("total") * 100, 2)).otherwise(0.0))
