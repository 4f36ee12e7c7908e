"""File contents: line ranges, signatures, import text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_LINES = 5000


def lines(content: Column) -> Column:
    return F.split(content, "\r?\n", -1)


def read_lines(content: Column, start: Column, end: Column, most: int = MAX_LINES) -> Column:
    """Lines start to end (from 1, both included): a start below 1 is 1, an end below 1 or beyond ``most`` is ``most``."""
    first = F.when(start <= 0, 1).otherwise(start)
    last = F.when((end <= 0) | (end > most), most).otherwise(end)
    return F.array_join(F.slice(lines(content), first, F.greatest(last - first + 1, F.lit(0))), "\n")


def snippet_end(start: Column, end: Column, span: int = 500) -> Column:
    """Last line of a snippet: not before its start, and at most ``span`` after it."""
    return F.when(end <= start, start).otherwise(F.least(end, start + span))


def signature(content: Column, line: Column, name: Column, most: int = 200) -> Column:
    """The trimmed source line (from 0) of an element, cut to ``most`` characters; its name where there is no such line."""
    text = F.substring(F.trim(F.get(lines(content), line)), 1, most)
    return F.when(F.coalesce(F.length(text), F.lit(0)) > 0, text).otherwise(name)


def import_text(content: Column, start: Column, end: Column) -> Column:
    """The import's lines (from 0, both included) trimmed and joined by one space, blank ones dropped."""
    part = F.transform(F.slice(lines(content), start + 1, end - start + 1), lambda x: F.trim(x))
    return F.array_join(F.filter(part, lambda x: F.length(x) > 0), " ")


def skeleton(elements: DataFrame, contents: DataFrame) -> DataFrame:
    """(path, ordinal, name, element_type, is_definition, start_line from 1, signature) of each file's elements."""
    text = contents.select(F.col("path").alias("cpath"), "content")
    joined = elements.join(text, F.col("path") == F.col("cpath"))
    return joined.select("path", "ordinal", "name", "element_type", "is_definition", (F.col("sl") + 1).alias("start_line"), signature(F.col("content"), F.col("sl"), F.col("name")).alias("signature"))
