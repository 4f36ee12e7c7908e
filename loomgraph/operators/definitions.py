"""Definition queries: by name, by line range, by snippet; and the quota of rows that get content."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.imports import dotted, in_package, visible
from ..functions.params import DEFINITIONS, symbol_names


def by_names(symbols: DataFrame, names: str) -> DataFrame:
    """Occurrences of the names in a comma-separated list (what follows the last dot counts)."""
    wanted = symbols.sparkSession.range(1).select(F.explode(F.array_distinct(symbol_names(F.lit(names)))).alias("name"))
    return symbols.join(F.broadcast(wanted), "name")


def by_lines(elements: DataFrame, imports: DataFrame, symbols: DataFrame, ranges: DataFrame) -> DataFrame:
    """What is defined or used in line ranges: ranges has path, start and end (from 0).

    Definitions that begin in the range are given as they are.  For other elements the definitions
    of their name and language are looked up, and those that the file can see are kept; if it sees
    none, all are.  Rows: path, start, end (of the range), name, def_path, sl, el, element_type.
    """
    asked = ranges.select(F.col("path").alias("path_"), F.col("start"), F.col("end"))
    inside = elements.join(asked, (F.col("path") == F.col("path_")) & F.col("sl").between(F.col("start"), F.col("end"))).drop("path_")
    own = inside.where(F.col("element_type").isin(*DEFINITIONS)).select("path", "start", "end", "name", F.col("path").alias("def_path"), "sl", "el", "element_type")
    used = inside.where(~F.col("element_type").isin(*DEFINITIONS)).select("path", "start", "end", "ordinal", "language", "name")
    folded = imports.join(asked.select("path_").distinct(), F.col("path") == F.col("path_")).groupBy("path").agg(F.collect_set(F.struct("name", "source")).alias("imports"))
    used = used.join(folded.withColumnRenamed("path", "ipath"), F.col("path") == F.col("ipath"), "left").drop("ipath")
    found = used.join(symbols.select("language", "name", F.col("path").alias("def_path"), F.col("sl").alias("dsl"), F.col("el").alias("del_"), "element_type", dotted(F.col("path")).alias("dotted")), ["language", "name"])
    found = found.withColumn("seen", visible(F.col("def_path"), F.col("path"), F.col("imports"), F.col("dotted")))
    found = found.withColumn("any_seen", F.max("seen").over(Window.partitionBy("path", "start", "end", "ordinal")))
    found = found.where("seen or not any_seen").select("path", "start", "end", "name", "def_path", F.col("dsl").alias("sl"), F.col("del_").alias("el"), "element_type")
    return own.unionByName(found)


def by_snippet(names: DataFrame, imports: DataFrame, symbols: DataFrame) -> DataFrame:
    """Definitions of the distinct names that a snippet uses; with imports, only those in files that one of them contains.

    names: language, name.  imports: name, source of the snippet (few), matched without fallback.
    """
    found = symbols.join(names.select("language", "name").distinct(), ["language", "name"])
    few = imports.agg(F.collect_set(F.struct("name", "source")).alias("imports"))
    seen = F.exists("imports", lambda i: in_package(F.col("path"), i["name"], i["source"]))
    return found.crossJoin(F.broadcast(few)).where((F.size("imports") == 0) | seen).drop("imports")  # one row: all the imports


def with_content_quota(definitions: DataFrame, *, total: int = 20, longest: int = 200) -> DataFrame:
    """Which rows get their content: each name its share of ``total``, in order of ``ordinal``.

    A name's share is rounded half up.  Rows longer than ``longest`` lines get none and use none up.
    """
    per_name = Window.partitionBy("name")
    counted = definitions.withColumn("of_name", F.count(F.lit(1)).over(per_name))
    n = definitions.agg(F.count(F.lit(1)).alias("of_all"))
    counted = counted.crossJoin(F.broadcast(n)).withColumn("cap", F.floor(F.col("of_name") / F.col("of_all") * total + 0.5))  # one row: the count
    fits = (F.col("el") - F.col("sl") <= longest).cast("int")
    used = F.sum(fits).over(per_name.orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0))
    return counted.withColumn("used", used).select(*definitions.columns, F.col("cap").cast("long").alias("cap"), ((fits == 1) & (F.col("used") <= F.col("cap"))).alias("has_content"))
