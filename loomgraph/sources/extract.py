"""Elements of source texts: definitions, calls, references, imports, packages, with ranges and arity.

Python is parsed by its own parser.  The other languages are read by a reduced grammar: comments
and string contents are blanked, definitions are recognised by their heads, their ends by
matching braces, calls by a name before parentheses.  A text that can't be parsed gives no rows.

Types that are named by parameters, results, fields and variables are rows of their own
(REFERENCE), unless they belong to the language.  scope tells from where a definition is seen:
block and function, class, file, package or project.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.params import STANDARD_TYPES
from ..functions.paths import LANGUAGES

SCHEMA = "path string, language string, ordinal int, name string, element_type string, is_definition boolean, sl int, sc int, el int, ec int, params array<string>, arity int, source string, alias string, owner string, types array<string>, return_type array<string>, scope string"
_FIELDS = ("path", "language", "ordinal", "name", "element_type", "is_definition", "sl", "sc", "el", "ec", "params", "arity", "source", "alias", "owner", "types", "return_type", "scope")
DEFINED = frozenset(("CLASS", "INTERFACE", "METHOD", "FUNCTION", "VARIABLE"))
#: Words before parentheses that are no calls.
KEYWORDS = frozenset("if for while switch return catch func function def class new sizeof typeof await async void super this throw else do try case select go defer synchronized using namespace operator import require delete in of instanceof yield static_cast dynamic_cast alignof decltype constructor".split())

_BLANK = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", re.S)
_NAME = r"[A-Za-z_$][\w$]*"


class _Text:
    """A source text with blanked comments and strings of the same length."""

    def __init__(self, raw: str):
        self.raw = raw
        self.text = _BLANK.sub(lambda m: m[0][0] + re.sub(r"[^\n]", " ", m[0][1:-1]) + m[0][-1] if m[0][0] in "\"'`" else re.sub(r"[^\n]", " ", m[0]), raw)
        self.starts = [0, *(m.end() for m in re.finditer("\n", raw))]

    def at(self, offset: int) -> tuple[int, int]:
        line = bisect_right(self.starts, offset) - 1
        return line, offset - self.starts[line]

    def closing(self, offset: int, pair: str = "{}") -> int:
        """Offset after the bracket that closes the one at offset; the text's end without one."""
        depth = 0
        for m in re.compile("[" + re.escape(pair) + "]").finditer(self.text, offset):
            depth += 1 if m[0] == pair[0] else -1
            if not depth:
                return m.end()
        return len(self.text)


def _split(text: str) -> list[str]:
    """Parts between commas outside of brackets, blank ones dropped."""
    parts, depth, start = [], 0, 0
    for i, c in enumerate(text):
        if c in "([{<":
            depth += 1
        elif c in ")]}>":
            depth -= c != ">" or depth > 0
        elif c == "," and not depth:
            parts.append(text[start:i])
            start = i + 1
    parts.append(text[start:])
    return [p.strip() for p in parts if p.strip()]


def _param_name(language: str, part: str) -> str:
    """The name of one parameter; a variadic one starts with "..."."""
    variadic = "..." if "..." in part else ""
    part = re.sub(r"=.*", "", part.replace("...", " "), flags=re.S).strip()
    if language in ("go", "typescript", "javascript"):
        name = re.match(rf"(?:(?:public|private|protected|readonly)\s+)*({_NAME})", part)
    else:
        name = re.search(rf"({_NAME})\s*(?:\[[^\]]*\]\s*)*$", part)
    return variadic + (name[1] if name else "")


def _param_type(language: str, part: str) -> str:
    """The type of one parameter as it is written; empty where there is none."""
    part = re.sub(r"=.*", "", part.replace("...", " "), flags=re.S).strip()
    if language == "go":
        found = re.match(rf"{_NAME}\s+(.+)$", part, re.S)
    elif language in ("typescript", "javascript"):
        found = re.match(rf"(?:(?:public|private|protected|readonly)\s+)*{_NAME}\s*\??\s*:\s*(.+)$", part, re.S)
    else:
        found = re.match(rf"(?:final\s+)?(.+?)[\s&*]+{_NAME}\s*(?:\[[^\]]*\]\s*)*$", part, re.S)
    return re.sub(r"\s+", " ", found[1]).strip() if found else ""


def _go_params(parts: list[str]) -> list[tuple[str, str]]:
    """(name, type) of Go parameters: names without a type have that of the next one with it."""
    out, last = [], ""
    for part in reversed(parts):
        last = _param_type("go", part) or last
        out.append((_param_name("go", part), last))
    return out[::-1]


def type_names(text: str) -> list[str]:
    """The names of a type's text that belong to no language, each once: the last part of a path, the arguments of a generic."""
    names = (m[0].rsplit(".", 1)[-1] for m in re.finditer(rf"{_NAME}(?:\s*(?:\.|::)\s*{_NAME})*", text.replace("::", ".")))
    return [n for n in dict.fromkeys(names) if n not in _STANDARD]


_STANDARD = frozenset(STANDARD_TYPES) | frozenset("const struct enum class final volatile static unsigned signed func map chan interface typeof keyof readonly extends super std vector optional Optional Union Dict Any Promise Array Record Partial".split())

#: Heads of definitions: (kind, pattern whose group "name" is the name and whose end may be an opening parenthesis).
_HEADS = {
    "go": [
        ("METHOD", rf"\bfunc\s*\(\s*(?:{_NAME}\s+)?\*?(?P<owner>{_NAME})[^)]*\)\s*(?P<name>{_NAME})\s*(?:\[[^\]]*\])?\("),
        ("FUNCTION", rf"\bfunc\s+(?P<name>{_NAME})\s*(?:\[[^\]]*\])?\("),
        ("CLASS", rf"\btype\s+(?P<name>{_NAME})\s*(?:\[[^\]]*\])?\s*struct\b"),
        ("INTERFACE", rf"\btype\s+(?P<name>{_NAME})\s*(?:\[[^\]]*\])?\s*interface\b"),
        ("VARIABLE", rf"\b(?:var|const)\s+(?P<name>{_NAME}(?:\s*,\s*{_NAME})*)"),
        ("VARIABLE", rf"(?P<name>\b{_NAME}(?:\s*,\s*{_NAME})*)\s*:="),
    ],
    "java": [
        ("INTERFACE", rf"\binterface\s+(?P<name>{_NAME})"),
        ("CLASS", rf"\b(?:class|enum|record)\s+(?P<name>{_NAME})"),
        ("METHOD", rf"(?<![\w.])(?!return\b|new\b|else\b|throw\b)(?=[A-Za-z_<])[\w$<>\[\], ?.]*[\w$>\]]\s+(?P<name>{_NAME})\s*\((?=[^()]*\)\s*(?:throws[^{{;]*)?[{{;])"),
        ("VARIABLE", rf"(?<![\w.])(?!return\b|new\b|import\b|package\b|throw\b|else\b)(?:[A-Za-z_][\w$.]*(?:<[^;=(){{}}]*>)?(?:\[\])*)\s+(?P<name>{_NAME})\s*(?==[^=]|;)"),
    ],
    "javascript": [
        ("CLASS", rf"\bclass\s+(?P<name>{_NAME})"),
        ("FUNCTION", rf"\bfunction\s*\*?\s*(?P<name>{_NAME})\s*(?:<[^>(]*>)?\("),
        ("FUNCTION", rf"\b(?:const|let|var)\s+(?P<name>{_NAME})\s*(?::[^=;]*)?=\s*(?:async\s*)?\((?=[^()]*\)\s*(?::[^=;{{]*)?=>)"),
        ("VARIABLE", rf"\b(?:const|let|var)\s+(?P<name>{_NAME})(?!\s*(?::[^=;]*)?=\s*(?:async\s*)?\([^()]*\)\s*(?::[^=;{{]*)?=>)(?!\s*=\s*require\b)"),
        ("METHOD", rf"(?m)^[ \t]+(?:(?:async|static|get|set|public|private|protected|override|readonly|\*)\s*)*(?P<name>{_NAME})\s*(?:<[^>(]*>)?\((?=[^()]*\)\s*(?::[^{{;]*)?\{{)"),
    ],
    "cpp": [
        ("CLASS", rf"\b(?:class|struct|union|enum(?:\s+class)?|namespace)\s+(?P<name>{_NAME})\s*(?:final\s*)?(?=[:{{])"),
        ("METHOD", rf"(?P<owner>{_NAME})::(?P<name>~?{_NAME})\s*\((?=[^()]*\)\s*(?:const\b|noexcept\b|override\b|\s)*[{{:])"),
        ("FUNCTION", rf"(?<![\w.:>])(?!return\b|else\b|new\b|delete\b)[A-Za-z_][\w:<>,&* ]*[\w>&*]\s+[*&]*(?P<name>{_NAME})\s*\((?=[^()]*\)\s*(?:const\b|noexcept\b|override\b|\s)*[{{;])"),
        ("VARIABLE", rf"(?<![\w.:>])(?!return\b|using\b|typedef\b|else\b|goto\b|namespace\b)[A-Za-z_][\w:]*(?:<[^;=(){{}}]*>)?[\s*&]+(?P<name>{_NAME})\s*(?:\[[^\]]*\]\s*)?(?==[^=]|;)"),
    ],
}
_HEADS["typescript"] = [("INTERFACE", rf"\binterface\s+(?P<name>{_NAME})"), ("CLASS", rf"\benum\s+(?P<name>{_NAME})"), *_HEADS["javascript"]]
_COMPILED = {language: [(kind, re.compile(p)) for kind, p in heads] for language, heads in _HEADS.items()}
_CALL = re.compile(rf"(?P<new>\bnew\s+)?(?:(?P<owner>{_NAME})\s*(?:\.|->|::)\s*)?(?<![\w$])(?P<name>{_NAME})\s*(?:<[\w\s,.<>\[\]]*>)?\(")
_PARENTS = re.compile(rf"\b(?:extends|implements|public|protected|private)\s+(?P<names>{_NAME}(?:\s*,\s*{_NAME})*)")


def _imports(language: str, t: _Text) -> Iterator[tuple[str, str, str, int, int]]:
    """(name, source, alias, start, end)."""
    raw = t.raw
    if language == "go":
        for m in re.finditer(rf"(?m)^\s*import\s+(?:(?P<alias>[\w.]+)\s+)?\"(?P<source>[^\"]+)\"", raw):
            yield m["source"].rsplit("/", 1)[-1], m["source"], m["alias"] or "", m.start(), m.end()
        for block in re.finditer(r"(?m)^\s*import\s*\(([^)]*)\)", raw):
            for m in re.finditer(r"(?:(?P<alias>[\w.]+)\s+)?\"(?P<source>[^\"]+)\"", block[1]):
                yield m["source"].rsplit("/", 1)[-1], m["source"], m["alias"] or "", block.start(1) + m.start(), block.start(1) + m.end()
    elif language == "java":
        for m in re.finditer(r"(?m)^\s*import\s+(?:static\s+)?(?P<name>[\w.*]+)\s*;", t.text):
            yield m["name"], "", "", m.start(), m.end()
    elif language == "cpp":
        for m in re.finditer(r"(?m)^\s*#\s*include\s*(?P<name><[^>\n]+>|\"[^\"\n]+\")", raw):
            yield m["name"].strip("<>\""), "", "", m.start(), m.end()
    else:
        for m in re.finditer(r"(?m)^\s*import\s+(?:type\s+)?(?:(?P<what>[^'\";]+?)\s+from\s+)?['\"](?P<source>[^'\"]+)['\"]", raw):
            what = re.sub(r"[{}*]|\bas\s+\w+|\btype\b", " ", m["what"] or "")
            alias = re.search(r"\bas\s+(\w+)", m["what"] or "")
            for name in _split(what.strip()) or [m["source"]]:
                yield name, m["source"], alias[1] if alias else "", m.start(), m.end()
        for m in re.finditer(rf"(?:const|let|var)\s+(?P<name>{_NAME}|\{{[^}}]*\}})\s*=\s*require\(\s*['\"](?P<source>[^'\"]+)['\"]\s*\)", raw):
            for name in _split(m["name"].strip("{}")):
                yield name.split(":")[0].strip(), m["source"], "", m.start(), m.end()


def _returned(language: str, text: str, m: re.Match, close: int) -> list[str]:
    """Types that a function's head gives for its result, as they are written."""
    if language == "go":
        after = re.compile(r"\s*(\([^()]*\)|[^\s{][^{\n]*)?").match(text, close)
        found = (after[1] or "").strip() if after else ""
        parts = _split(found.strip("()"))
        return [re.sub(rf"^{_NAME}\s+(?=[\w*\[])", "", p) if found.startswith("(") else p for p in parts]
    if language in ("typescript", "javascript"):
        after = re.compile(r"\s*:\s*([^{};=]+?)\s*(?=[{;]|=>|$)").match(text, close)
        return [after[1].strip()] if after and after[1].strip() != "void" else []
    before = re.sub(r"\b(?:public|private|protected|static|final|abstract|synchronized|native|inline|virtual|explicit|extern|constexpr|default)\b", " ", m[0][: m.start("name") - m.start()])
    before = re.sub(r"@\w+(?:\([^)]*\))?|<[^<>]*>\s*(?=\w+[\w\s<>\[\]]*$)|::", " ", before) if language == "java" else before.replace("::", " ") if m.groupdict().get("owner") else before
    kind = re.sub(r"\s+", " ", before).strip(" *&")
    return [kind] if kind and kind != "void" else []


def _declared(language: str, text: str, m: re.Match) -> str:
    """The type that a variable is declared with, as it is written; empty where there is none."""
    if language in ("go", "typescript", "javascript"):
        after = re.compile(r"\s*:\s*([^=;\n]+)" if language != "go" else rf"[ \t]+(?!=)([*\[\]\w.{{}}]+)").match(text, m.end())
        return after[1].strip() if after and ":=" not in m[0] else ""
    return re.sub(r"\b(?:public|private|protected|static|final|const|volatile|transient|mutable|extern|constexpr)\b", " ", m[0][: m.start("name") - m.start()]).strip(" *&\n\t")


#: Members of a body: fields of Go structs, properties of classes and interfaces.
_GO_FIELD = re.compile(rf"(?m)^[ \t]*(?P<names>{_NAME}(?:[ \t]*,[ \t]*{_NAME})*)[ \t]+(?P<type>[*\[\]\w.(){{}} ]+?)[ \t]*(?:`[^`]*`)?[ \t]*$|(?m:^)[ \t]*(?P<embedded>\*?{_NAME}(?:\.{_NAME})?)[ \t]*$")
_PROPERTY = re.compile(rf"(?m)^[ \t]*(?:(?:public|private|protected|static|readonly|declare|override)[ \t]+)*(?P<names>#?{_NAME})[ \t]*[?!]?[ \t]*(?::[ \t]*(?P<type>[^=;\n(]+?))?[ \t]*(?:=(?!>)[^;\n]*)?[;,]?[ \t]*$")


def _members(language: str, t: _Text, m: re.Match, end: int, row) -> Iterator[dict]:
    """Fields of the class or interface whose head is m: those that lie in no inner braces."""
    opening = t.text.find("{", m.end())
    if not 0 <= opening < end:
        return
    body, depth = list(t.text[opening + 1 : end - 1]), 0
    for i, c in enumerate(body):  # what inner braces and parentheses hold belongs to others
        depth += c in "{("
        if c == ";" and not depth and language != "go":
            body[i] = "\n"
        elif depth and c not in "{(\n":
            body[i] = " "
        depth -= c in "})" and depth > 0
    embedded = []
    for f in (_GO_FIELD if language == "go" else _PROPERTY).finditer("".join(body)):
        found = f.groupdict()
        a = opening + 1 + f.start() + len(f[0]) - len(f[0].lstrip())
        kind = (found.get("type") or "").strip()
        if found.get("embedded"):
            embedded.append((found["embedded"], a, opening + 1 + f.end()))
            continue
        if language != "go" and not kind and "=" not in f[0]:
            continue
        for name in found["names"].split(","):
            if name.strip().lstrip("#") not in KEYWORDS:
                yield row(name.strip().lstrip("#"), "VARIABLE", a, opening + 1 + f.end(), owner=m["name"], types=[kind] if kind else [], head=f[0])
        for name in type_names(kind):
            yield row(name, "REFERENCE", a, opening + 1 + f.end(), owner=m["name"])
    for text, a, b in embedded:
        for name in type_names(text):
            yield row(name, "REFERENCE", a, b, owner=m["name"])


_DESTRUCTURED = re.compile(rf"\b(?:const|let|var)\s*(?P<what>\{{[^{{}}]*\}}|\[[^\[\]]*\])\s*=(?!\s*require\b)")


def _destructured(t: _Text, row) -> Iterator[dict]:
    """Variables of const {a, b: c = 1, ...rest} = x and const [a, b] = x."""
    for m in _DESTRUCTURED.finditer(t.text):
        for part in _split(m["what"][1:-1]):
            name = re.search(rf"({_NAME})\s*$", re.sub(r"=.*", "", part, flags=re.S))
            if name:
                yield row(name[1], "VARIABLE", m.start(), m.end() - 1, head=m[0])


def _scoped(language: str, rows: list[dict]) -> list[dict]:
    """The rows with the scope of each definition: where it lies, and what its name or modifiers say."""
    around: list[tuple[tuple[int, int], str]] = []
    for r in sorted(rows, key=lambda r: ((r["sl"], r["sc"]), (-r["el"], -r["ec"]), r["element_type"] == "VARIABLE")):
        start = (r["sl"], r["sc"])
        while around and around[-1][0] <= start:
            around.pop()
        inside = around[-1][1] if around else ""
        kind, head = r["element_type"], r.pop("head", "")
        if kind in ("FUNCTION", "METHOD", "CLASS", "INTERFACE"):
            around.append(((r["el"], r["ec"]), kind))
        if kind not in DEFINED:
            continue
        if inside in ("FUNCTION", "METHOD"):
            r["scope"] = "function"
        elif language == "go":
            r["scope"] = "project" if "A" <= r["name"][0] <= "Z" else "package"
        elif re.search(r"\bprivate\b", head):
            r["scope"] = "class"
        elif re.search(r"\bprotected\b", head):
            r["scope"] = "package"
        elif inside in ("CLASS", "INTERFACE") and not re.search(r"\bpublic\b", head):
            r["scope"] = "project" if inside == "INTERFACE" else "package" if language == "java" else "class"
        elif language in ("python", "cpp") or re.search(r"\bpublic\b", head) or (language == "java" and kind == "INTERFACE"):
            r["scope"] = "project"
        else:
            r["scope"] = "package" if language == "java" else "file"
    return rows


def _braced(language: str, raw: str) -> Iterator[dict]:
    t = _Text(raw)

    def row(name: str, kind: str, a: int, b: int, **more) -> dict:
        (sl, sc), (el, ec) = t.at(a), t.at(max(a, b))
        return {"name": name, "element_type": kind, "sl": sl, "sc": sc, "el": el, "ec": ec} | more

    package = re.search(r"(?m)^\s*package\s+([\w.]+)", t.text)
    if package and language in ("go", "java"):
        yield row(package[1], "PACKAGE", package.start(), package.end())
    for name, source, alias, a, b in _imports(language, t):
        yield row(name, "IMPORT", a, b, source=source, alias=alias)
    heads: set[int] = set()
    for kind, pattern in _COMPILED[language]:
        for m in pattern.finditer(t.text):
            at = m.start("name")
            if at in heads or (kind in ("METHOD", "FUNCTION") and m["name"] in KEYWORDS):
                continue
            heads.add(at)
            start = m.start() + len(m[0]) - len(m[0].lstrip())
            names, end, more, named = [m["name"]], m.end(), {"owner": m.groupdict().get("owner") or "", "head": re.split(r"[\n;{}]", t.text[max(0, m.start() - 200) : m.start()])[-1] + m[0]}, []
            if kind in ("METHOD", "FUNCTION") and t.text[m.end() - 1] == "(":
                close = t.closing(m.end() - 1, "()")
                parts = [p for p in _split(t.text[m.end() : close - 1]) if p != "void"]
                pairs = _go_params(parts) if language == "go" else [(_param_name(language, p), _param_type(language, p)) for p in parts]
                params, types = [p for p, _ in pairs], [p for _, p in pairs]
                returned = _returned(language, t.text, m, close)
                end, more = close, more | {"params": params, "types": types, "return_type": returned, "arity": len(params) - bool(params and params[-1].startswith("..."))}
                named = [*types, *returned]
            if kind != "VARIABLE":
                brace = re.compile(r"[{;]").search(t.text, end)
                end = t.closing(brace.start()) if brace and brace[0] == "{" else brace.end() if brace else end
            else:
                names = [n.strip() for n in m["name"].split(",")]
                named = [_declared(language, t.text, m)]
                more["types"] = [x for x in named if x]
            for name in names:
                if name != "_":
                    yield row(name, kind, start, end, **more)
            for name in dict.fromkeys(n for x in named for n in type_names(x)):
                yield row(name, "REFERENCE", start, m.end(), owner=names[0])
            if kind in ("CLASS", "INTERFACE") and language in ("go", "javascript", "typescript"):
                yield from _members(language, t, m, end, row)
            if kind in ("CLASS", "INTERFACE"):
                opening = t.text.find("{", m.end())
                for parents in _PARENTS.finditer(t.text, m.end(), opening if opening > 0 else m.end()):
                    for name in _split(parents["names"]):
                        yield row(name, "REFERENCE", parents.start("names"), parents.end("names"))
    if language in ("javascript", "typescript"):
        yield from _destructured(t, row)
    for m in _CALL.finditer(t.text):
        at = m.start("name")
        if at in heads or m["name"] in KEYWORDS or re.search(r"\b(?:func|function|def|class|interface)\s*$", t.text[max(0, at - 12) : at]):
            continue
        close = t.closing(m.end() - 1, "()")
        args = _split(t.text[m.end() : close - 1])
        yield row(m["name"], "CALL", m.start(), close, params=args, arity=len(args), owner=m["owner"] or "")


class _Python(ast.NodeVisitor):
    def __init__(self):
        self.rows: list[dict] = []
        self.owner: list[str] = []

    def _row(self, node: ast.AST, name: str, kind: str, **more) -> None:
        self.rows.append({"name": name, "element_type": kind, "sl": node.lineno - 1, "sc": node.col_offset, "el": node.end_lineno - 1, "ec": node.end_col_offset} | more)

    def visit_Import(self, node: ast.Import) -> None:
        for a in node.names:
            self._row(node, a.name, "IMPORT", source="", alias=a.asname or "")

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        for a in node.names:
            self._row(node, a.name, "IMPORT", source="." * node.level + (node.module or ""), alias=a.asname or "")

    def _function(self, node) -> None:
        a = node.args
        names = [x.arg for x in (*a.posonlyargs, *a.args)]
        method = bool(self.owner and self.owner[-1])
        if method and names and names[0] in ("self", "cls"):
            names = names[1:]
        names += [f"...{a.vararg.arg}"] if a.vararg else []
        names += [x.arg for x in a.kwonlyargs]
        names += [f"...{a.kwarg.arg}"] if a.kwarg else []
        every = [x for x in (*a.posonlyargs, *a.args, a.vararg, *a.kwonlyargs, a.kwarg) if x][-len(names) :] if names else []
        types = [ast.unparse(x.annotation) if x.annotation else "" for x in every]
        returned = [ast.unparse(node.returns)] if node.returns and ast.unparse(node.returns) != "None" else []
        self._row(node, node.name, "METHOD" if method else "FUNCTION", params=names, types=types, return_type=returned, arity=len(names) - bool(names and names[-1].startswith("...")), owner=self.owner[-1] if method else "")
        self._types(node, [*types, *returned], node.name)
        self.owner.append("")
        self.generic_visit(node)
        self.owner.pop()

    visit_FunctionDef = visit_AsyncFunctionDef = _function

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        self._row(node, node.name, "CLASS")
        for base in node.bases:
            name = base.attr if isinstance(base, ast.Attribute) else getattr(base, "id", None)
            if name:
                self._row(base, name, "REFERENCE")
        self.owner.append(node.name)
        self.generic_visit(node)
        self.owner.pop()

    def _types(self, node: ast.AST, texts: list[str], owner: str) -> None:
        for name in dict.fromkeys(n for x in texts for n in type_names(x.strip("'\""))):
            self._row(node, name, "REFERENCE", owner=owner)

    def _targets(self, node: ast.AST, target: ast.AST, types: list[str]) -> None:
        owner = self.owner[-1] if self.owner else ""
        if isinstance(target, ast.Tuple | ast.List):
            for part in target.elts:
                self._targets(node, part, types)
        elif isinstance(target, ast.Starred):
            self._targets(node, target.value, types)
        elif isinstance(target, ast.Name) and target.id != "_":
            self._row(node, target.id, "VARIABLE", owner=owner, types=types)
        elif isinstance(target, ast.Attribute) and getattr(target.value, "id", "") == "self":
            self._row(node, target.attr, "VARIABLE", owner=next((o for o in reversed(self.owner) if o), ""), types=types)

    def visit_Assign(self, node: ast.Assign) -> None:
        for target in node.targets:
            self._targets(node, target, [])
        self.generic_visit(node)

    def visit_AnnAssign(self, node: ast.AnnAssign) -> None:
        kind = ast.unparse(node.annotation)
        self._targets(node, node.target, [kind])
        self._types(node, [kind], getattr(node.target, "id", ""))
        self.generic_visit(node)

    def visit_NamedExpr(self, node: ast.NamedExpr) -> None:
        self._targets(node, node.target, [])
        self.generic_visit(node)

    def visit_Call(self, node: ast.Call) -> None:
        f = node.func
        name, owner = (f.attr, getattr(f.value, "id", "")) if isinstance(f, ast.Attribute) else (getattr(f, "id", ""), "")
        if name:
            args = [ast.unparse(a) for a in node.args] + [k.arg or "" for k in node.keywords]
            self._row(node, name, "CALL", params=args, arity=len(args), owner=owner)
        self.generic_visit(node)


def elements_of(path: str, content: str) -> list[dict]:
    """Rows of one file in order of position; none for an unsupported language or a text that can't be parsed."""
    extension = re.search(r"(\.[^./]*)$", path or "")
    language = LANGUAGES.get(extension[1]) if extension else None
    if language is None or content is None:
        return []
    if language == "python":
        visitor = _Python()
        try:
            visitor.visit(ast.parse(content))
        except (SyntaxError, ValueError, RecursionError):
            return []
        found = visitor.rows
    else:
        found = list(_braced(language, content))
    found = _scoped(language, found)
    found.sort(key=lambda r: (r["sl"], r["sc"], r["el"], r["element_type"], r["name"]))
    return [{"path": path, "language": language, "ordinal": i, "is_definition": r["element_type"] in DEFINED} | r for i, r in enumerate(found)]


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = {"ordinal": pa.int32(), "is_definition": pa.bool_(), "params": pa.list_(pa.string()), "types": pa.list_(pa.string()), "return_type": pa.list_(pa.string()), "arity": pa.int32()} | dict.fromkeys(("sl", "sc", "el", "ec"), pa.int32())
    for batch in batches:
        for start in range(0, batch.num_rows, 200):
            part = batch.slice(start, 200)
            rows = [r for p, c in zip(part.column("path").to_pylist(), part.column("content").to_pylist(), strict=True) for r in elements_of(p, c)]
            yield pa.RecordBatch.from_arrays([pa.array([r.get(f) for r in rows], kinds.get(f, pa.string())) for f in _FIELDS], names=list(_FIELDS))


def extract_elements(files: DataFrame) -> DataFrame:
    """Elements, imports and packages of files (path, content)."""
    return files.select(F.col("path").cast("string").alias("path"), F.col("content").cast("string").alias("content")).mapInArrow(_run, SCHEMA)


#: Names of definition kinds in a file's structure.
_STRUCTURE = {
    "go": {"FUNCTION": "declaration.function", "METHOD": "declaration.method", "CLASS": "declaration.struct", "INTERFACE": "declaration.interface", "VARIABLE": "global_variable"},
    "java": {"METHOD": "declaration.method", "CLASS": "declaration.class", "INTERFACE": "declaration.interface", "VARIABLE": "declaration.field"},
    "python": {"FUNCTION": "definition.function", "METHOD": "definition.method", "CLASS": "definition.class", "VARIABLE": "variable"},
    "javascript": {"FUNCTION": "declaration.function", "METHOD": "definition.method", "CLASS": "declaration.class", "VARIABLE": "global_variable"},
    "typescript": {"FUNCTION": "declaration.function", "METHOD": "definition.method", "CLASS": "declaration.class", "INTERFACE": "declaration.interface", "VARIABLE": "declaration.variable"},
    "cpp": {"FUNCTION": "definition.function", "METHOD": "definition.function", "CLASS": "definition.class", "VARIABLE": "variable"},
}


def file_structure(files: DataFrame) -> DataFrame:
    """(path, type, name, start_line, end_line from 1) of the definitions of each file."""
    kind = F.coalesce(*[F.when(F.col("language") == lang, F.element_at(F.create_map(*[F.lit(x) for p in names.items() for x in p]), F.col("element_type"))) for lang, names in _STRUCTURE.items()])
    found = extract_elements(files).where("is_definition")
    return found.select("path", kind.alias("type"), "name", (F.col("sl") + 1).alias("start_line"), (F.col("el") + 1).alias("end_line")).where("type is not null")
