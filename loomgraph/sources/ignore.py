"""Ignore rules in the gitignore notation as column predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Folders and files that are ignored without being named, and accepted extensions.
DEFAULT_RULES = (".*", "logs/", "temp/", "tmp/", "node_modules/", "bin/", "dist/", "build/", "out/", "__pycache__/", "venv/", "target/", "vendor/", "*.log", "*.tmp", "*.bak", "*.backup")
MAX_BYTES = 2048 * 1024


def rules_of(*texts: str, defaults: tuple[str, ...] = DEFAULT_RULES) -> list[str]:
    """The defaults and the lines of ignore files, without comments, blanks and repeats, in order."""
    lines = [line.strip() for t in texts for line in t.splitlines()]
    return list(dict.fromkeys([*defaults, *(x for x in lines if x and not x.startswith("#"))]))


def rule_pattern(rule: str) -> tuple[str, bool]:
    """(regular expression on "dir/file" or "dir/", negated) of one rule."""
    negated = rule.startswith("!")
    body = rule[negated:]
    folder = body.endswith("/")
    body = body.rstrip("/")
    anchored = "/" in body
    body = body.lstrip("/")
    out, i = "", 0
    while i < len(body):
        c = body[i]
        if body.startswith("**/", i):
            out, i = out + "(.*/)?", i + 3
        elif body.startswith("**", i):
            out, i = out + ".*", i + 2
        elif c == "*":
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and "]" in body[i + 1 :]:
            end = body.index("]", i + 1)
            out, i = out + "[" + body[i + 1 : end].replace("!", "^", 1) + "]", end + 1
        else:
            out, i = out + ("\\" + c if c in "\\^$.|?*+()[]{}" else c), i + 1
    return f"^{'' if anchored else '(.*/)?'}{out}{'/' if folder else '(/|$)'}", negated


def ignored(path: Column, rules: list[str]) -> Column:
    """The last rule that matches the relative path decides; folders end with a slash."""
    out = F.lit(False)
    for rule in rules:  # later rules stand outside and so go first
        pattern, negated = rule_pattern(rule)
        out = F.when(path.rlike(pattern), F.lit(not negated)).otherwise(out)
    return out


def rejected(path: Column, size: Column, rules: list[str], extensions: tuple[str, ...], *, most: int = MAX_BYTES, inclusive: bool = False) -> Column:
    """A file is left out: too large (a scan counts ``most`` itself as too large), ignored, or of another extension."""
    too_large = size >= most if inclusive else size > most
    other = ~F.regexp_extract(path, "(\\.[^./]*)$", 1).isin(*extensions) if extensions else F.lit(False)
    return too_large | ignored(path, rules) | other
