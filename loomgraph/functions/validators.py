"""Checks of what a client asks for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Languages that a query may name.
QUERY_LANGUAGES = ("go", "javascript", "typescript", "python", "java", "c", "cpp", "csharp", "php", "ruby", "rust", "kotlin", "scala", "swift", "objective-c")


def valid_codebase_id(text: Column) -> Column:
    """3 to 50 letters, digits, hyphens and underscores."""
    return F.coalesce(text.rlike("^[A-Za-z0-9_-]{3,50}$"), F.lit(False))


def valid_path(path: Column) -> Column:
    """1 to 1024 bytes without "..", "~", a backslash or a zero character."""
    size = F.octet_length(path)
    return F.coalesce((size >= 1) & (size <= 1024) & ~path.rlike("\\.\\.|~|\\\\|\\x00"), F.lit(False))


def sanitised_path(path: Column) -> Column:
    """An absolute path without empty and "." parts; empty stays empty; null if ".." is left when "name/.." pairs are resolved."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    stack = F.aggregate(parts, F.array().cast("array<string>"), lambda kept, p: F.when((p == "..") & (F.size(kept) > 0) & (F.try_element_at(kept, F.lit(-1)) != ".."), F.slice(kept, F.lit(1), F.size(kept) - 1)).when((p == "..") & path.startswith("/"), kept).otherwise(F.concat(kept, F.array(p))))
    clean = F.concat(F.lit("/"), F.array_join(stack, "/"))
    return F.when(path == "", "").when(~clean.contains(".."), clean)


def page(number: Column, size: Column) -> Column:
    """struct(page, size): at least page 1; a size below 1 is 20, one above 100 is 100."""
    return F.struct(F.greatest(number, F.lit(1)).alias("page"), F.when(size < 1, 20).otherwise(F.least(size, F.lit(100))).alias("size"))


def tree_depth(depth: Column) -> Column:
    """From 1 to 10."""
    return F.least(F.greatest(depth, F.lit(1)), F.lit(10))


def valid_symbol(name: Column) -> Column:
    """1 to 255 bytes."""
    return F.coalesce(F.octet_length(name).between(1, 255), F.lit(False))


def valid_language(language: Column) -> Column:
    """None, or a language that is known, in any case."""
    return F.coalesce((language == "") | F.lower(language).isin(*QUERY_LANGUAGES), F.lit(True))
