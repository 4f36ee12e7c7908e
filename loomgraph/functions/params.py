"""Parameters and names of elements."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stored kinds of captured elements, and back.
STORED_KIND = {
    "definition.function": "FUNCTION", "definition.method": "METHOD", "definition.class": "CLASS", "definition.interface": "INTERFACE",
    "definition.struct": "CLASS", "definition.enum": "CLASS", "definition.union": "CLASS", "definition.trait": "INTERFACE",
    "call.function": "CALL", "call.method": "CALL", "call.struct": "CALL", "reference": "REFERENCE",
    "variable": "VARIABLE", "constant": "VARIABLE", "global_variable": "VARIABLE", "local_variable": "VARIABLE",
    "import": "IMPORT", "package": "PACKAGE", "namespace": "PACKAGE",
}
SHOWN_KIND = {"FUNCTION": "definition.function", "METHOD": "definition.method", "CALL": "call.method", "REFERENCE": "reference", "CLASS": "definition.class", "INTERFACE": "definition.interface", "VARIABLE": "variable", "IMPORT": "import", "PACKAGE": "package"}
DEFINITION_KIND = {"call.method": "definition.method", "call.function": "definition.function", "reference": "definition.class"}
DEFINITIONS = ("CLASS", "INTERFACE", "METHOD", "FUNCTION", "VARIABLE")


def is_variadic(params: Column) -> Column:
    """The last parameter's name holds "..."."""
    last = F.element_at(params, -1)
    return F.when(F.coalesce(F.size(params), F.lit(0)) > 0, F.contains(last["name"], F.lit("..."))).otherwise(False)


def param_count(params: Column) -> Column:
    """Parameters, the variadic one not counted."""
    return F.coalesce(F.size(params), F.lit(0)) - is_variadic(params).cast("int")


def arity_fits(args: Column, params: Column, variadic: Column) -> Column:
    """A call with args arguments can mean a definition with params fixed parameters."""
    return F.when(variadic, args >= params).otherwise(args == params)


def symbol_names(text: Column) -> Column:
    """Names of a comma-separated list: what follows the last dot, trimmed, empty ones dropped."""
    return F.filter(F.transform(F.split(text, ","), lambda s: F.trim(F.substring_index(s, ".", -1))), lambda s: F.length(s) > 0)


def valid_name(name: Column) -> Column:
    return name.rlike("^[a-zA-Z_$\\-][a-zA-Z0-9_$\\-]*$")


def clean_param(text: Column) -> Column:
    """A C-style parameter reduced to its type words: qualifiers, pointers, arrays and templates go."""
    out = text
    for pattern, new in (
        ("/\\*.*?\\*/|//.*$", " "), ("<[^<>]*>", " "), ("<[^<>]*>", " "), ("\\[[^\\]]*\\]", " "), ("=.*$", " "),
        ("\\b(const|volatile|static|register|restrict|struct|enum|union|class|typename|final|mutable|inline|extern)\\b", " "),
        ("[*&]+", " "), ("\\s+", " "),
    ):
        out = F.regexp_replace(out, pattern, new)
    return F.trim(out)


#: Type names of a language, which are no types of a project.
STANDARD_TYPES = ("bool", "boolean", "byte", "char", "complex64", "complex128", "double", "error", "float", "float32", "float64", "int", "int8", "int16", "int32", "int64", "long", "rune", "short", "str", "string", "String", "uint", "uint8", "uint16", "uint32", "uint64", "uintptr", "void", "any", "object", "Object", "number", "symbol", "undefined", "null", "None", "list", "dict", "tuple", "set", "Integer", "Long", "Double", "Float", "Boolean", "Byte", "Character", "Short", "List", "Map", "Set", "auto", "size_t", "unsigned", "signed", "wchar_t")


def custom_types(types: Column) -> Column:
    """The types of an array that belong to no language, each once, in order."""
    return F.array_except(types, F.array(*map(F.lit, STANDARD_TYPES)))


def go_scope(name: Column) -> Column:
    """project for a name that begins with A to Z, else package."""
    return F.when(name.rlike("^[A-Z]"), "project").otherwise("package")


def modifier_scope(modifiers: Column, kind: Column) -> Column:
    """Scope by access modifiers, the narrowest first; without any by the kind of declaration."""
    plain = F.when(kind.isin("interface", "struct"), "project").when(kind == "class_specifier", "class").otherwise("package")
    return F.when(modifiers.contains("private"), "class").when(modifiers.contains("protected"), "package").when(modifiers.contains("public"), "project").otherwise(plain)


_EXTRA = "array<struct<name:string,type:array<string>>>"


def encoded_extra(params: Column, returns: Column, supers: Column) -> Column:
    """Further facts of an element as a map of JSON texts; what is null or empty has no key."""
    facts = F.map_from_arrays(F.array(F.lit("parameters"), F.lit("returnType"), F.lit("superClasses")), F.array(F.to_json(params), F.to_json(returns), F.to_json(supers)))
    return F.map_filter(facts, lambda _, v: v.isNotNull() & (v != "[]"))


def decoded_extra(extra: Column) -> Column:
    """Inverse of ``encoded_extra``: struct(params, return_type, super_classes); a key that is missing gives an empty array."""
    read = lambda key, kind: F.coalesce(F.from_json(F.try_element_at(extra, F.lit(key)), kind), F.array().cast(kind))
    return F.struct(read("parameters", _EXTRA).alias("params"), read("returnType", "array<string>").alias("return_type"), read("superClasses", "array<string>").alias("super_classes"))


def occurrence_key(name: Column, path: Column, sl: Column, sc: Column, el: Column, ec: Column) -> Column:
    return F.concat(name, F.lit("::"), path, F.lit("::"), F.concat_ws(":", sl, sc, el, ec))
