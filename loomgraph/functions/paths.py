"""File paths as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Languages by file extension.
LANGUAGES = {
    ".go": "go",
    ".java": "java",
    ".py": "python",
    ".js": "javascript", ".jsx": "javascript", ".vue": "javascript", ".Vue": "javascript",
    ".ts": "typescript", ".tsx": "typescript",
    ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".hpp": "cpp", ".h": "cpp", ".c": "cpp",
}


def mapped(values: dict, key: Column) -> Column:
    """values[key], null for another key."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), key)


def to_unix(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent_dir(path: Column) -> Column:
    """What is before the last slash; the path itself without one."""
    return F.regexp_replace(path, "/[^/]*$", "")


def extension(path: Column) -> Column:
    """From the last dot of the last component on; empty without one."""
    return F.regexp_extract(path, "(\\.[^./]*)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), "\\.[^.]*$", "")


def infer_language(path: Column) -> Column:
    """Language by the last extension; null for one that isn't supported."""
    return mapped(LANGUAGES, extension(path))


def is_hidden(path: Column) -> Column:
    """Any component but "." and ".." starts with a dot."""
    return F.exists(F.split(path, "/"), lambda p: p.startswith(".") & ~p.isin(".", ".."))


def is_subdir(parent: Column, child: Column) -> Column:
    """child lies strictly below parent."""
    slashed = lambda c: F.concat(F.regexp_replace(to_unix(c), "/+$", ""), F.lit("/"))
    return F.startswith(slashed(child), slashed(parent)) & (slashed(child) != slashed(parent))


def same_parent(a: Column, b: Column) -> Column:
    return parent_dir(a) == parent_dir(b)


def under(path: Column, folder: Column) -> Column:
    """Prefix rule of index scans: path is below folder."""
    return F.startswith(path, with_separator(folder))


def with_separator(path: Column) -> Column:
    return F.when(F.endswith(path, F.lit("/")), path).otherwise(F.concat(path, F.lit("/")))


def without_separator(path: Column) -> Column:
    return F.regexp_replace(path, "/$", "")


def absolute(workspace: Column, path: Column) -> Column:
    """path, joined to workspace unless it lies in it."""
    return F.when(is_subdir(workspace, path), path).otherwise(F.concat(without_separator(workspace), F.lit("/"), F.regexp_replace(path, "^/+", "")))


def common_level(a: Column, b: Column) -> Column:
    """Number of leading folders that both paths share."""
    x, y = F.split(parent_dir(a), "/"), F.split(parent_dir(b), "/")
    n = F.least(F.size(x), F.size(y))
    differs = F.filter(F.sequence(F.lit(1), n), lambda i: F.element_at(x, i) != F.element_at(y, i))
    return F.when(F.size(differs) > 0, F.array_min(differs) - 1).otherwise(n)


def resolve_relative(source: Column, file: Column) -> Column:
    """An import source that starts with a dot, seen from the file: up one folder for each "../"."""
    folder = F.split(parent_dir(file), "/")
    ups = F.regexp_count(source, F.lit("\\.\\./"))
    rest = F.regexp_replace(F.regexp_replace(source, "\\./", ""), "^\\.+", "")
    kept = F.slice(folder, F.lit(1), F.greatest(F.size(folder) - ups, F.lit(0)))
    return F.array_join(F.concat(kept, F.filter(F.split(rest, "/"), lambda p: F.length(p) > 0)), "/")


def project_id(name: Column, path: Column) -> Column:
    """name, "_" and the first 32 hex digits of the path's SHA-256."""
    return F.concat(name, F.lit("_"), F.substring(F.sha2(path, 256), 1, 32))


def codebase_id(path: Column) -> Column:
    return F.concat(base_name(path), F.lit("_"), F.md5(path))


def visit_skips(path: Column, is_dir: Column, *, exclude_exts=(), include_exts=(), exclude_dirs=(), include_dirs=(), exclude_prefixes=(), include_prefixes=()) -> Column:
    """The walk leaves this entry out: the rules in their fixed order, the first that speaks decides."""
    base, ext = base_name(path), extension(path)
    starts = lambda prefixes: F.lit(False) if not prefixes else base.rlike("^(" + "|".join(_quoted(p) for p in prefixes) + ")")
    rules = [(ext != "") & ext.isin(*exclude_exts) if exclude_exts else F.lit(False)]
    if include_exts:
        rules.append(~is_dir & ~ext.isin(*include_exts))
    if exclude_dirs:
        rules.append(is_dir & base.isin(*exclude_dirs))
    if include_dirs:
        rules.append(is_dir & ~base.isin(*include_dirs))
    rules.append(starts(exclude_prefixes))
    if include_prefixes:
        rules.append(~starts(include_prefixes))
    out = rules[0]
    for rule in rules[1:]:
        out = out | rule
    return out


def _quoted(text: str) -> str:
    return "".join("\\" + c if c in "\\^$.|?*+()[]{}" else c for c in text)
