"""Listings, ignore rules, projects, extraction and queue streams on small made-up files."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from loomgraph.plans.catalogue import ORACLE_SQL, QUERIES
from loomgraph.sources import extract, ignore, workspace
from loomgraph.streaming import queue as stream_queue

from test_operators import QUEUE, T1, T2, event, rows


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("ws")
    for path, content in {
        "src/a.go": "package a\n", "src/b.py": "x = 1\n", "node_modules/m.js": "1", "big.go": "x" * 5000, ".hidden/x.go": "", "notes.txt": "n", "mod/go.mod": "module acme.org/lib\n\ngo 1.22\n", "keep.log": "1",
    }.items():
        os.makedirs(top / os.path.dirname(path), exist_ok=True)
        (top / path).write_text(content)
    return str(top)


def test_listing(spark, folder):
    files = workspace.listing(spark, folder)
    rules = ignore.rules_of("# comment\n\n*.log\n!keep.log\n")
    kept = workspace.accepted(files, rules, extensions=(".go", ".py", ".js", ".log"), most_bytes=5000)
    assert rows(kept, "path") == [("keep.log",), ("src/a.go",), ("src/b.py",)]
    assert rows(workspace.accepted(files, rules, extensions=(".go", ".py"), most_bytes=5000, most_files=1), "path") == [("src/a.go",)]
    assert all(len(r["hash"]) == 13 for r in workspace.hash_tree(files, "id").collect())
    mods = workspace.go_modules(workspace.contents(spark, folder))
    assert rows(mods) == [("mod", "acme.org/lib")]


@pytest.mark.parametrize(
    ("rule", "path", "want"),
    [("*.log", "a/b.log", True), ("/a", "a/x", True), ("/a", "b/a", False), ("dist/", "x/dist/y", True), ("dist/", "dist", False), ("**/t/*.go", "a/t/x.go", True), ("a?c", "abc", True), ("[ab].go", "b.go", True), ("x", "xy", False)],
)
def test_rules(spark, rule, path, want):
    assert spark.range(1).select(ignore.ignored(F.lit(path), [rule])).first()[0] is want


def test_projects(spark):
    at = lambda paths: rows(workspace.projects(spark.createDataFrame([(p,) for p in paths], "path string"), "/w"))
    assert at(["a/.git/config", "a/b/.git/config", "c/x.go"]) == [("/w/a",)]
    assert at([".git/config", "a/.git/config"]) == [("/w",)]
    assert at(["x.go"]) == [("/w",)]


def test_manifest_in_parts(spark):
    """Parts list each change once between them, those of a null or repeated path too."""
    paths = [(f"f{i}", "add") for i in range(50)] + [("f7", "delete"), ("f7", "add"), (None, "add"), ('a"b\\c\n', "modify")]
    made = workspace.manifest(spark.createDataFrame(paths, "path string, status string"), "base", size=10)
    assert made.count() > 1
    found = workspace.manifest_files(made)
    assert sorted(((r["path"], r["status"]) for r in found.collect()), key=repr) == sorted(paths, key=repr)


@pytest.mark.parametrize(("copies", "renamed"), [(0, True), (40_000, True), (40, False)])
def test_change_manifest_of_any_size(spark, tmp_path, copies, renamed):
    """One row, as in SQL: of no changes, of more than a part holds, of several rows for a path."""
    span = 10 if copies < 1000 else copies * 10
    ids = spark.range(0, span * (copies if not renamed else 1) if copies else 0)
    name = F.col("id") if renamed else F.col("id") % span
    ids.select(F.col("id").alias("c_custkey"), F.concat(F.lit("c"), name.cast("string")).alias("c_name")).write.parquet(f"{tmp_path}/customer.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
    want = con.execute(ORACLE_SQL["change_manifest"]).fetchall()
    got = [(r["part"], r["files"]) for r in QUERIES["change_manifest"](spark, str(tmp_path)).collect()]
    assert got == want
    assert (got[0][1] > 100_000) == (copies == 40_000)


GO = '''package demo

import (
	"fmt"
	al "acme/lib"
)

// func hidden() {}
type Box struct {
	n int
}

type Shape interface { Area() int }

func (b *Box) Size(a, c int, rest ...string) int {
	return al.Count(a, "x(1)", c)
}

func main() {
	x, y := 1, 2
	fmt.Println(x, y)
}
'''


def found(path, content, kind):
    return [(r["name"], r["sl"], r["el"], r.get("arity")) for r in extract.elements_of(path, content) if r["element_type"] == kind]


def test_go():
    assert found("a.go", GO, "FUNCTION") == [("main", 18, 21, 0)]
    assert found("a.go", GO, "METHOD")[0][:3] == ("Size", 14, 16)
    assert found("a.go", GO, "METHOD")[0][3] == 2  # the variadic parameter isn't counted
    assert found("a.go", GO, "CLASS") == [("Box", 8, 10, None)]
    assert [x[0] for x in found("a.go", GO, "INTERFACE")] == ["Shape"]
    assert [(x[0], x[3]) for x in found("a.go", GO, "CALL") if x[0] != "Area"] == [("Count", 3), ("Println", 2)]
    assert [x[0] for x in found("a.go", GO, "VARIABLE")] == ["n", "x", "y"]  # a struct's field too
    assert [(r["name"], r["source"], r["alias"]) for r in extract.elements_of("a.go", GO) if r["element_type"] == "IMPORT"] == [("fmt", "fmt", ""), ("lib", "acme/lib", "al")]


PYTHON = '''import os
from .core import run as go

class A(Base):
    def m(self, a, *args, **kw):
        return go(a, 1)

def f(x: int = 3):
    n: int = A().m(x)
    return n
'''


def test_python():
    assert found("a.py", PYTHON, "METHOD") == [("m", 4, 5, 2)]
    assert found("a.py", PYTHON, "FUNCTION") == [("f", 7, 9, 1)]
    assert found("a.py", PYTHON, "CLASS") == [("A", 3, 5, None)]
    assert [(x[0], x[3]) for x in found("a.py", PYTHON, "CALL")] == [("go", 2), ("A", 0), ("m", 1)] or sorted((x[0], x[3]) for x in found("a.py", PYTHON, "CALL")) == [("A", 0), ("go", 2), ("m", 1)]
    assert [x[0] for x in found("a.py", PYTHON, "VARIABLE")] == ["n"]
    assert [x[0] for x in found("a.py", PYTHON, "REFERENCE")] == ["Base"]
    assert extract.elements_of("a.py", "def broken(") == []


JAVA = '''package x.y;
import java.util.List;
public class Shop extends Base implements Door {
  private int count = 0;
  public Shop(int n) { this.count = n; }
  static String name(List<String> a, int b) throws Exception {
    return join(a, b);
  }
}
'''
TS = '''import { a, b as c } from './lib';
const d = require('./old');
export interface Thing { n: number }
export class Box extends Base {
  size(x: number, y?: string): number {
    return helper(x, y);
  }
}
export const add = (p: number, q: number) => p + q;
let z = add(1, 2);
'''
CPP = '''#include <vector>
#include "my/lib.h"
namespace n {
class Box : public Base {
};
int Box::size(int a, const char *b) const {
  return count(a);
}
static int add(int a, int b) { return a + b; }
int total = add(1, 2);
}
'''


def test_java():
    assert ("name", 5, 7, 2) in found("a.java", JAVA, "METHOD")
    assert found("a.java", JAVA, "CLASS") == [("Shop", 2, 8, None)]
    assert ("count", 3, 3, None) in found("a.java", JAVA, "VARIABLE")
    assert ("join", 6, 6, 2) in found("a.java", JAVA, "CALL")
    assert [x[0] for x in found("a.java", JAVA, "REFERENCE")] == ["Base", "Door"]
    assert [x[0] for x in found("a.java", JAVA, "IMPORT")] == ["java.util.List"]


def test_typescript():
    assert ("size", 4, 6, 2) in found("a.ts", TS, "METHOD")
    assert [x[0] for x in found("a.ts", TS, "FUNCTION")] == ["add"]
    assert [x[0] for x in found("a.ts", TS, "INTERFACE")] == ["Thing"]
    assert [x[0] for x in found("a.ts", TS, "VARIABLE")] == ["n", "z"]
    assert [(x[0], x[3]) for x in found("a.ts", TS, "CALL")] == [("helper", 2), ("add", 2)]
    assert {x[0] for x in found("a.ts", TS, "IMPORT")} == {"a", "b", "d"}


def test_cpp():
    assert ("size", 5, 7, 2) in found("a.cpp", CPP, "METHOD")
    assert ("add", 8, 8, 2) in found("a.cpp", CPP, "FUNCTION")
    assert [x[0] for x in found("a.cpp", CPP, "CLASS")] == ["n", "Box"]
    assert ("total", 9, 9, None) in found("a.cpp", CPP, "VARIABLE")
    assert [x[0] for x in found("a.cpp", CPP, "IMPORT")] == ["vector", "my/lib.h"]


def table(path, content):
    """(line, kind, name, types, return type, scope) of what isn't a call, import or package."""
    return [(r["sl"], r["element_type"], r["name"], r.get("types"), r.get("return_type"), r.get("scope")) for r in extract.elements_of(path, content) if r["element_type"] not in ("CALL", "IMPORT", "PACKAGE")]


def test_python_variables_and_types():
    text = "x = 1\na, (b, *c) = 1, (2, 3)\nclass K:\n    f: Thing = None\n    def m(self, p: Box, *args: int) -> Out:\n        self.h = y = p\n"
    assert table("a.py", text) == [
        (0, "VARIABLE", "x", [], None, "project"), (1, "VARIABLE", "a", [], None, "project"), (1, "VARIABLE", "b", [], None, "project"), (1, "VARIABLE", "c", [], None, "project"),
        (2, "CLASS", "K", None, None, "project"), (3, "REFERENCE", "Thing", None, None, None), (3, "VARIABLE", "f", ["Thing"], None, "class"),
        (4, "METHOD", "m", ["Box", "int"], ["Out"], "class"), (4, "REFERENCE", "Box", None, None, None), (4, "REFERENCE", "Out", None, None, None),
        (5, "VARIABLE", "h", [], None, "function"), (5, "VARIABLE", "y", [], None, "function"),
    ]


def test_go_fields_groups_and_results():
    text = "package p\ntype Pt struct {\n\tA, b int `json:\"a\"`\n\tC *pkg.Thing\n\tBase\n}\nfunc (p *Pt) Do(a, b int, c In) (out Result, err error) {\n\tloc := 1\n}\nfunc New() *Pt { return nil }\n"
    assert table("a.go", text) == [
        (1, "CLASS", "Pt", None, None, "project"), (2, "VARIABLE", "A", ["int"], None, "project"), (2, "VARIABLE", "b", ["int"], None, "package"),
        (3, "REFERENCE", "Thing", None, None, None), (3, "VARIABLE", "C", ["*pkg.Thing"], None, "project"), (4, "REFERENCE", "Base", None, None, None),
        (6, "REFERENCE", "In", None, None, None), (6, "REFERENCE", "Result", None, None, None), (6, "METHOD", "Do", ["int", "int", "In"], ["Result", "error"], "project"),
        (7, "VARIABLE", "loc", [], None, "function"), (9, "FUNCTION", "New", [], ["*Pt"], "project"), (9, "REFERENCE", "Pt", None, None, None),
    ]


def test_java_types_and_scopes():
    text = "public class Box {\n  private static final List<Item> items = null;\n  protected int n;\n  public Map<String, Item> get(final Thing a, int... xs) { int loc = 1; }\n  void plain() { }\n}\ninterface I { }\n"
    assert table("a.java", text) == [
        (0, "CLASS", "Box", None, None, "project"), (1, "REFERENCE", "Item", None, None, None), (1, "VARIABLE", "items", ["List<Item>"], None, "class"), (2, "VARIABLE", "n", ["int"], None, "package"),
        (3, "METHOD", "get", ["Thing", "int"], ["Map<String, Item>"], "project"), (3, "REFERENCE", "Item", None, None, None), (3, "REFERENCE", "Thing", None, None, None), (3, "VARIABLE", "loc", ["int"], None, "function"),
        (4, "METHOD", "plain", [], [], "package"), (6, "INTERFACE", "I", None, None, "project"),
    ]


def test_typescript_properties_and_destructuring():
    text = "class Box {\n  private name: Thing;\n  count = 1;\n  run(a: In): Promise<Out> { const { p, q: r = 1, ...rest } = a; }\n}\ninterface S { area: number; kind: Kind }\nconst [m, n] = arr;\n"
    assert table("a.ts", text) == [
        (0, "CLASS", "Box", None, None, "file"), (1, "REFERENCE", "Thing", None, None, None), (1, "VARIABLE", "name", ["Thing"], None, "class"), (2, "VARIABLE", "count", [], None, "class"),
        (3, "METHOD", "run", ["In"], ["Promise<Out>"], "class"), (3, "REFERENCE", "In", None, None, None), (3, "REFERENCE", "Out", None, None, None),
        (3, "VARIABLE", "p", None, None, "function"), (3, "VARIABLE", "r", None, None, "function"), (3, "VARIABLE", "rest", None, None, "function"),
        (5, "INTERFACE", "S", None, None, "file"), (5, "VARIABLE", "area", ["number"], None, "project"), (5, "REFERENCE", "Kind", None, None, None), (5, "VARIABLE", "kind", ["Kind"], None, "project"),
        (6, "VARIABLE", "m", None, None, "file"), (6, "VARIABLE", "n", None, None, "file"),
    ]


def test_extraction_as_table(spark):
    files = spark.createDataFrame([("a.go", GO), ("b.py", PYTHON), ("c.rs", "fn x() {}"), ("d.py", None), (None, "x")], "path string, content string")
    got = extract.extract_elements(files)
    assert {r["path"] for r in got.select("path").distinct().collect()} == {"a.go", "b.py"}
    assert ("a.go", "declaration.function", "main", 19, 22) in rows(extract.file_structure(files))


def run_stream(spark, tmp_path, transform, batches, schema):
    """The result of a stream over one file for each batch, read in order."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(f"{source}/b{i}")
    read = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(source)
    transform(read).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.parquet(out)


def test_stream_upserts(spark, tmp_path):
    batches = [[event(1, "add_file", "x", 1, 1, T1)], [event(2, "delete_file", "x", 3, 1, T2)], [event(3, "add_file", "x", 1, 1, T2)]]
    got = run_stream(spark, tmp_path, stream_queue.upserts, batches, QUEUE)
    assert sorted(r["action"] for r in got.collect()) == ["create", "create", "update"]


def test_stream_retention(spark, tmp_path):
    one = event(1, "add_file", "x", 1, 1, T1)
    got = run_stream(spark, tmp_path, stream_queue.recent, [[one], [one, event(2, "add_file", "y", 1, 1, T1)]], QUEUE)
    assert rows(got, "id") == [(1,), (2,)]


def test_stream_drain(spark, tmp_path):
    spark.createDataFrame([event(1, "delete_file", "x", 1, 1, T1), event(2, "add_file", "y", 1, 1, T2)], QUEUE).write.parquet(str(tmp_path / "in"))
    seen = []
    stream = spark.readStream.schema(QUEUE).parquet(str(tmp_path / "in"))
    stream_queue.drain(stream, lambda df, _: seen.extend(r["event_type"] for r in df.collect()), str(tmp_path / "c")).awaitTermination()
    assert seen == ["add_file", "delete_file"]


def test_stream_drain_handles_every_event(spark, tmp_path):
    """A batch of 25 events of one type and 3 of another: polls of ten, none lost, types in order in each poll."""
    events = [event(i, "modify_file", f"p{i}", 1, 1, T1) for i in range(25)] + [event(100 + i, "add_file", f"q{i}", 1, 1, T2) for i in range(3)] + [event(200, "add_file", "busy", 1, 2, T1)]
    spark.createDataFrame(events, QUEUE).coalesce(1).write.parquet(str(tmp_path / "in"))
    polls = []
    stream = spark.readStream.schema(QUEUE).parquet(str(tmp_path / "in"))
    stream_queue.drain(stream, lambda df, _: polls.append([r["id"] for r in df.collect()]), str(tmp_path / "c")).awaitTermination()
    assert polls == [[100, 101, 102, *range(10)], list(range(10, 20)), list(range(20, 25))]


def test_listing_enters_what_it_should(spark, tmp_path):
    """Names with an underscore are files like others; hidden and ignored folders are never entered."""
    for name in ("pkg/__init__.py", "pkg/_x.py", "_priv/deep/z.py", ".git/q.py", "node_modules/m/i.js", "a.py"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(f"# {name}")
    assert rows(workspace.listing(spark, str(tmp_path)), "path") == [("_priv/deep/z.py",), ("a.py",), ("node_modules/m/i.js",), ("pkg/__init__.py",), ("pkg/_x.py",)]
    assert rows(workspace.listing(spark, str(tmp_path), "*.py", rules=["node_modules/", "_priv/"]), "path") == [("a.py",), ("pkg/__init__.py",), ("pkg/_x.py",)]
    assert rows(workspace.listing(spark, str(tmp_path), most=1), "path") == [("a.py",)]  # ends after the first level
    assert rows(workspace.contents(spark, str(tmp_path), "__init__.py"), "path", "content", "size") == [("pkg/__init__.py", "# pkg/__init__.py", 17)]
