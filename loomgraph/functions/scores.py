"""How well a caller's file matches the file of what it calls."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .imports import dotted
from .paths import parent_dir, stem


def bigrams(text: Column) -> Column:
    """Distinct pairs of neighbouring characters."""
    n = F.length(text)
    return F.when(n >= 2, F.array_distinct(F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substr(text, i, F.lit(2))))).otherwise(F.array().cast("array<string>"))


def dice(a: Column, b: Column) -> Column:
    """Dice coefficient of the bigram sets; equal texts without bigrams give 1."""
    x, y = bigrams(a), bigrams(b)
    total = F.size(x) + F.size(y)
    return F.when(total > 0, 2 * F.size(F.array_intersect(x, y)) / total).otherwise((a == b).cast("double"))


def caller_facts(path: Column) -> Column:
    """What ``match_facts`` takes from a caller's file: its folder, its name without ending, and how many bigrams that has."""
    return F.struct(parent_dir(path).alias("folder"), stem(path).alias("stem"), F.size(bigrams(stem(path))).alias("n"))


def callee_facts(path: Column) -> Column:
    """What ``match_facts`` takes from a callee's file: its folder, dotted path, name without ending, and the name's bigrams."""
    return F.struct(parent_dir(path).alias("folder"), dotted(path).alias("dotted"), stem(path).alias("stem"), bigrams(stem(path)).alias("grams"))


def match_facts(caller: Column, of_caller: Column, callee: Column, of_callee: Column, imported: Column) -> Column:
    """``match_score`` of two files by their facts; imported: names and sources of the caller's imports.

    A bigram of one name is among the other's if the other name contains it.
    """
    total = F.size(of_callee["grams"]) + of_caller["n"]
    both = F.size(F.filter(of_callee["grams"], lambda g: F.contains(of_caller["stem"], g)))
    alike = F.when(total > 0, 2 * both / total).otherwise((of_caller["stem"] == of_callee["stem"]).cast("double"))
    names = F.lit(15) + F.floor(alike * 10).cast("int") + F.lit(1)
    known = F.exists(imported, lambda i: F.contains(of_callee["dotted"], i))
    return F.when(caller == callee, 100).when(of_caller["folder"] == of_callee["folder"], 75).when(F.coalesce(known, F.lit(False)), 50).otherwise(names)


def match_score(caller: Column, callee: Column, imports: Column) -> Column:
    """100: one file; 75: one folder; 50: the caller imports the callee's file; else 16 to 26 by file names.

    The last case has 15 for the symbol's name and 1 for the folder, which are the same for every pair.
    """
    imported = F.concat(F.transform(imports, lambda i: i["name"]), F.transform(imports, lambda i: i["source"]))
    return match_facts(caller, caller_facts(caller), callee, callee_facts(callee), imported)
