"""Source files written from the element table, for extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sources(elements: DataFrame) -> DataFrame:
    """(path, content): each element of a file as a line of its language, in order."""
    lang, name, kind, n = F.col("language"), F.col("name"), F.col("element_type"), F.col("arity")
    one = lambda text: F.array_join(F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), text), ", ")
    typed = F.when(lang == "go", one(lambda i: F.concat(F.lit("a"), i, F.lit(" int")))).when(lang.isin("java", "cpp"), one(lambda i: F.concat(F.lit("int a"), i))).when(lang == "typescript", one(lambda i: F.concat(F.lit("a"), i, F.lit(": number")))).otherwise(one(lambda i: F.concat(F.lit("a"), i)))
    args, use = one(lambda i: i.cast("string")), F.concat(F.lit("use_"), F.col("ordinal"))
    word = F.when(lang == "go", "func ").when(lang == "python", "def ").when(lang.isin("java", "cpp"), "int ").otherwise("function ")
    body = F.when(lang == "python", ": return 0").when(lang == "go", " int { return 0 }").when(lang == "typescript", ": number { return 0; }").otherwise(" { return 0; }")
    defined = F.concat(word, name, F.lit("("), typed, F.lit(")"), body)
    wrapper = F.when(lang == "java", "void ").when(lang == "cpp", "void ").otherwise(word)
    called = F.concat(wrapper, use, F.lit("()"), F.when(lang == "python", ": ").otherwise(" { "), name, F.lit("("), args, F.lit(")"), F.when(lang == "python", "").otherwise("; }"))
    value = F.when(lang == "go", F.concat(F.lit("var "), name, F.lit(" = 1"))).when(lang == "python", F.concat(name, F.lit(": int = 1"))).when(lang.isin("java", "cpp"), F.concat(F.lit("int "), name, F.lit(" = 1;"))).otherwise(F.concat(F.lit("const "), name, F.lit(" = 1;")))
    line = F.when(kind.isin("FUNCTION", "METHOD"), defined).when(kind == "CALL", called).otherwise(value)
    rows = elements.groupBy("path", "language").agg(F.array_sort(F.collect_list(F.struct("ordinal", line.alias("line")))).alias("lines"))
    head = F.when(lang == "go", 'package main\nimport "acme/lib"\n').when(lang == "java", "package acme.x;\nimport acme.lib.Thing;\npublic class Box {\n").when(lang == "python", "import acme.lib\n\n").when(lang == "cpp", '#include "acme/lib.h"\n\n').otherwise("import lib from './lib';\n\n")
    return rows.select("path", F.concat(head, F.array_join("lines.line", "\n"), F.when(lang == "java", "\n}\n").otherwise("\n")).alias("content"))
