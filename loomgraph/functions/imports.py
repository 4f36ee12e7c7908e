"""Import sources: classification, normalisation, containment."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .paths import resolve_relative, same_parent

#: Packages that belong to a language, not to a project.
GO_SYSTEM = ("fmt", "os", "io", "bufio", "strings", "strconv", "time", "encoding/json", "sync", "net/http", "database/sql", "reflect", "errors", "context", "flag", "log", "math", "sort", "unicode", "bytes", "crypto", "encoding/base64", "encoding/csv", "encoding/xml", "hash", "html", "image", "index/suffixarray", "io/ioutil", "net", "os/exec", "path", "regexp", "runtime", "syscall", "testing", "text/template", "unicode/utf8", "unsafe")
JAVA_SYSTEM = ("java.", "javax.", "jakarta.", "org.w3c.", "org.xml.", "org.omg.", "org.ietf.", "org.iso.", "org.unicode.", "com.sun.", "sun.", "jdk.")
PYTHON_SYSTEM = ("os", "sys", "io", "math", "json", "datetime", "re", "collections", "itertools", "random", "logging", "unittest", "pathlib", "subprocess", "threading", "multiprocessing", "socket", "http", "urllib", "csv", "xml", "email", "hashlib", "base64", "struct", "pickle", "copy", "enum", "functools", "operator", "dataclasses", "typing", "asyncio", "contextlib", "glob", "tempfile", "shutil")
C_SYSTEM = ("stdio.h", "stdlib.h", "string.h", "math.h", "ctype.h", "time.h", "stdint.h", "stdbool.h", "assert.h", "limits.h", "errno.h", "signal.h", "pthread.h", "sys/stat.h", "fcntl.h", "unistd.h", "stddef.h", "setjmp.h", "stdarg.h", "float.h", "iso646.h", "locale.h", "wchar.h", "wctype.h")
CPP_SYSTEM = ("iostream", "vector", "string", "algorithm", "memory", "map", "set", "unordered_map", "unordered_set", "tuple", "functional", "thread", "mutex", "condition_variable", "future", "chrono", "regex", "fstream", "sstream", "iomanip", "array", "bitset", "deque", "forward_list", "list", "queue", "stack", "valarray", "complex", "exception", "initializer_list", "ios", "iosfwd", "istream", "limits", "locale", "ostream", "stdexcept", "streambuf", "typeinfo", "utility", "atomic", "cfenv", "codecvt", "csetjmp", "csignal", "cstdarg", "cstddef", "cstdint", "cstdio", "cstdlib", "cstring", "ctgmath", "ctime", "cwchar", "cwctype", "execution", "filesystem", "random", "ratio", "scoped_allocator", "shared_mutex", "strstream", "system_error", "type_traits")
NODE_SYSTEM = ("fs", "path", "http", "https", "url", "util", "os", "crypto", "stream", "events", "buffer", "child_process", "cluster", "dgram", "dns", "net", "querystring", "readline", "repl", "string_decoder", "timers", "tls", "tty", "v8", "vm", "zlib", "assert", "process")
SYSTEM_FOLDERS = ("/usr/include/", "/usr/local/include/", "/Library/Developer/CommandLineTools/usr/include/")


def _any_prefix(name: Column, prefixes: Column, ending: str = "") -> Column:
    return F.exists(prefixes, lambda p: (F.length(p) > 0) & F.startswith(name, F.concat(p, F.lit(ending))))


def classify_package(language: Column, name: Column, own: Column) -> Column:
    """"system", "project" or "unknown" for an imported name; own: the project's modules, prefixes or folders.

    A Go name is looked up as a whole; a Python or script name by its first part; headers lose
    quotes and, for C++, the ending ".h".
    """
    header = F.regexp_replace(name, "^[<>\"']+|[<>\"']+$", "")
    in_folder = F.lit(False)
    for folder in SYSTEM_FOLDERS:
        in_folder = in_folder | F.contains(header, F.lit(folder))
    root = F.split_part(name, F.lit("."), F.lit(1))
    script = F.regexp_replace(name, "^node:", "")
    relative = name.startswith("./") | name.startswith("../")
    system = (
        F.when(language == "go", name.isin(*GO_SYSTEM))
        .when(language == "java", _any_prefix(name, F.array(*map(F.lit, JAVA_SYSTEM))))
        .when(language == "python", root.isin(*PYTHON_SYSTEM))
        .when(language == "c", header.isin(*C_SYSTEM) | in_folder)
        .when(language == "cpp", F.regexp_replace(header, "\\.h$", "").isin(*CPP_SYSTEM) | header.isin(*C_SYSTEM) | in_folder)
        .otherwise(F.split_part(script, F.lit("/"), F.lit(1)).isin(*NODE_SYSTEM))
    )
    project = (
        F.when(language == "go", _any_prefix(name, own, "/") | relative)
        .when(language == "java", _any_prefix(name, own))
        .when(language == "python", name.startswith(".") | F.array_contains(own, root) | _any_prefix(name, own, "."))
        .when(language.isin("c", "cpp"), F.exists(own, lambda p: (F.length(p) > 0) & F.contains(header, p)))
        .otherwise(relative | F.array_contains(own, name))
    )
    return F.when(system, "system").when(project, "project").otherwise("unknown")


def strip_module(name: Column, modules: Column) -> Column:
    """name without the first of the Go modules that it starts with."""
    return F.aggregate(modules, name, lambda n, m: F.when((F.length(m) > 0) & F.startswith(n, F.concat(m, F.lit("/"))), F.substr(n, F.length(m) + 2)).otherwise(n))


def normalise(source: Column) -> Column:
    """Slashes as dots, stars dropped; an empty source becomes ".", which every path with a dot or slash holds."""
    out = F.replace(F.translate(source, "/\\", ".."), F.lit("*"), F.lit(""))
    return F.when(out == "", ".").otherwise(out)


def preprocess(language: Column, name: Column, source: Column, file: Column, modules: Column) -> Column:
    """struct(name, source) of an import as it is matched; null for a system package.

    In order: system packages go, Go modules are stripped, relative sources are resolved,
    separators are normalised.
    """
    go = (language == "go") & (F.size(modules) > 0)
    n, s = (F.when(go, strip_module(c, modules)).otherwise(c) for c in (name, source))
    relative = s.startswith(".")
    n, s = (F.when(relative, resolve_relative(c, file)).otherwise(c) for c in (n, s))
    return F.when(classify_package(language, name, modules) != "system", F.struct(normalise(n).alias("name"), normalise(s).alias("source")))


def dotted(path: Column) -> Column:
    return F.translate(path, "/\\", "..")


def named_in(path: Column, name: Column, source: Column) -> Column:
    """A dotted path contains the name or the source of an import."""
    return F.contains(path, name) | F.contains(path, source)


def in_package(path: Column, name: Column, source: Column) -> Column:
    """The file may be what the import means: its dotted path contains the name or the source."""
    return named_in(dotted(path), name, source)


def visible(path: Column, file: Column, imports: Column, with_dots: Column | None = None) -> Column:
    """A definition in path can be meant in file: same file, same folder or contained in an import (array of structs).

    with_dots: the path as ``dotted`` gives it, where it is at hand.
    """
    known = dotted(path) if with_dots is None else with_dots
    imported = F.exists(imports, lambda i: named_in(known, i["name"], i["source"]))
    return (path == file) | same_parent(path, file) | F.coalesce(imported, F.lit(False))
