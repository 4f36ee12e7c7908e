"""Source ranges: stored from 0 as [line, column, line, column], shown from 1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _position(*parts: Column) -> Column:
    return F.struct(*[p.cast("int").alias(n) for p, n in zip(parts, ("start_line", "start_column", "end_line", "end_column"), strict=True)])


def position(r: Column) -> Column:
    """1-based struct; three entries mean one line; any other length gives zeros."""
    at = lambda i: F.get(r, i) + 1
    zero = F.lit(0)
    return F.when(F.size(r) == 3, _position(at(0), at(1), at(0), at(2))).when(F.size(r) == 4, _position(at(0), at(1), at(2), at(3))).otherwise(_position(zero, zero, zero, zero))


def stored_range(p: Column) -> Column:
    """Inverse of ``position``."""
    return F.array(*[p[n] - 1 for n in ("start_line", "start_column", "end_line", "end_column")])


def shown(r: Column) -> Column:
    """Every entry plus one."""
    return F.transform(r, lambda x: x + 1)


def line_range(start: Column, end: Column, most: int) -> Column:
    """[start, end] made valid: start at least 1, end not before it, at most ``most`` lines."""
    first = F.greatest(start, F.lit(1))
    last = F.greatest(end, first)
    return F.array(first, F.when(last - first + 1 > most, first + most - 1).otherwise(last))


def parsed_lines(text: Column) -> Column:
    """[a, b] of "a-b", blanks around the numbers allowed; null for anything else."""
    part = lambda i: F.regexp_extract(text, "^\\s*([0-9]+)\\s*-\\s*([0-9]+)\\s*$", i).try_cast("int")
    return F.when(part(1).isNotNull() & part(2).isNotNull(), F.array(part(1), part(2)))


def contains_lines(sl: Column, el: Column, start: Column, end: Column) -> Column:
    """The element lies within the lines start to end."""
    return (start <= sl) & (end >= el)
