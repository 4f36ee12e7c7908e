"""Literal cases of the column functions."""

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import imports as I
from loomgraph.functions import params as P
from loomgraph.functions import paths as X
from loomgraph.functions import ranges as R
from loomgraph.functions import scores as S


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(("start", "end", "want"), [(0, 0, [1, 1]), (10, 5, [10, 10]), (1, 1000, [1, 200]), (5, 8, [5, 8])])
def test_line_range(spark, start, end, want):
    assert value(spark, R.line_range(F.lit(start), F.lit(end), 200)) == want


@pytest.mark.parametrize(("stored", "want"), [([3, 0, 5, 2], (4, 1, 6, 3)), ([3, 0, 7], (4, 1, 4, 8)), ([1, 2], (0, 0, 0, 0)), ([], (0, 0, 0, 0))])
def test_position(spark, stored, want):
    r = F.array(*map(F.lit, stored)).cast("array<int>")
    assert tuple(value(spark, R.position(r))) == want
    if len(stored) == 4:
        assert value(spark, R.stored_range(R.position(r))) == stored


@pytest.mark.parametrize(("text", "want"), [("3-9", [3, 9]), (" 3 - 9 ", [3, 9]), ("x-9", None), ("3", None), ("", None)])
def test_parsed_lines(spark, text, want):
    assert value(spark, R.parsed_lines(F.lit(text))) == want


def test_symbol_names(spark):
    assert value(spark, P.symbol_names(F.lit("types.Foo, bar ,x.y.Baz,,"))) == ["Foo", "bar", "Baz"]


@pytest.mark.parametrize(("path", "want"), [("a.go", "go"), ("A.vue", "javascript"), ("x.tsx", "typescript"), ("k.h", "cpp"), ("k.c", "cpp"), ("x.rs", None), ("Makefile", None), ("d.x/y", None)])
def test_language(spark, path, want):
    assert value(spark, X.infer_language(F.lit(path))) == want


@pytest.mark.parametrize(("path", "want"), [("/a/.git/x", True), ("/a/./b", False), ("../a/b", False), ("/a/b.c", False), (".x", True), ("/a/...", True)])
def test_hidden(spark, path, want):
    assert value(spark, X.is_hidden(F.lit(path))) is want


@pytest.mark.parametrize(("parent", "child", "want"), [("/a", "/a/b", True), ("/a", "/ab", False), ("/a", "/a", False), ("/a/", "/a/b", True), ("C:\\a", "C:\\a\\b", True)])
def test_subdir(spark, parent, child, want):
    assert value(spark, X.is_subdir(F.lit(parent), F.lit(child))) is want


def test_import_containment(spark):
    path = F.lit("/ws/p/src/a/B.java")
    contains = lambda n, s: value(spark, I.in_package(path, F.lit(n), I.normalise(F.lit(s))))
    assert contains("com.x.Y", "") is True  # an empty source becomes "."
    assert contains("com.x", "com.z") is False
    assert contains("src.a", "zz") is True


@pytest.mark.parametrize(("source", "want"), [("./util", "/w/a/util"), ("../lib/y", "/w/lib/y"), ("../../z", "/z"), ("../../../../z", "z")])
def test_resolve_relative(spark, source, want):
    assert value(spark, X.resolve_relative(F.lit(source), F.lit("/w/a/f.go"))) == want


@pytest.mark.parametrize(("args", "params", "variadic", "want"), [(3, 2, True, True), (1, 2, True, False), (2, 2, False, True), (3, 2, False, False)])
def test_arity(spark, args, params, variadic, want):
    assert value(spark, P.arity_fits(F.lit(args), F.lit(params), F.lit(variadic))) is want


@pytest.mark.parametrize(("names", "count", "variadic"), [(["a", "...args", "...kwargs"], 2, True), (["a"], 1, False), ([], 0, False), (None, 0, False)])
def test_param_count(spark, names, count, variadic):
    rows = spark.createDataFrame([([(n,) for n in names] if names is not None else None,)], "params array<struct<name:string>>")
    row = rows.select(P.param_count(F.col("params")), P.is_variadic(F.col("params"))).first()
    assert tuple(row) == (count, variadic)


def test_visit_rules(spark):
    skips = lambda path, is_dir=False: value(spark, X.visit_skips(F.lit(path), F.lit(is_dir), exclude_exts=(".min.js",), include_exts=(".go", ".js"), exclude_dirs=("vendor",), exclude_prefixes=("_",)))
    assert not skips("/a/b.go")
    assert skips("/a/b.py")
    assert skips("/a/Makefile")
    assert skips("/a/vendor", True)
    assert not skips("/a/src", True)
    assert skips("/a/_x.go")


@pytest.mark.parametrize(
    ("language", "name", "want"),
    [("go", "fmt", "system"), ("go", "json", "unknown"), ("go", "acme/x", "project"), ("java", "java.util.List", "system"), ("python", "os.path", "system"), ("python", ".x", "project"), ("cpp", "<vector>", "system"), ("c", '"stdio.h"', "system"), ("javascript", "./a", "project"), ("javascript", "react", "unknown")],
)
def test_packages(spark, language, name, want):
    assert value(spark, I.classify_package(F.lit(language), F.lit(name), F.array(F.lit("acme")))) == want


def test_preprocess(spark):
    got = value(spark, I.preprocess(F.lit("go"), F.lit("acme/lib/x"), F.lit("acme/lib/x"), F.lit("/w/a.go"), F.array(F.lit("acme"))))
    assert tuple(got) == ("lib.x", "lib.x")
    assert value(spark, I.preprocess(F.lit("go"), F.lit("fmt"), F.lit("fmt"), F.lit("/w/a.go"), F.array(F.lit("acme")))) is None


def test_scores(spark):
    none = F.array().cast("array<struct<name:string,source:string>>")
    score = lambda a, b, i=none: value(spark, S.match_score(F.lit(a), F.lit(b), i))
    assert score("/p/a.go", "/p/a.go") == 100
    assert score("/p/a.go", "/p/b.go") == 75
    assert score("/p/a.go", "/q/r/b.go", F.array(F.struct(F.lit("q.r").alias("name"), F.lit("zz").alias("source")))) == 50
    assert score("/p/abc.go", "/q/abc.go") == 26
    assert score("/p/abc.go", "/q/xyz.go") == 16


@pytest.mark.parametrize(("a", "b", "want"), [("night", "nacht", 0.25), ("a", "a", 1.0), ("a", "b", 0.0), ("", "", 1.0), ("ab", "ab", 1.0)])
def test_dice(spark, a, b, want):
    assert value(spark, S.dice(F.lit(a), F.lit(b))) == want


@pytest.mark.parametrize(("text", "want"), [("const char *name[]", "char name"), ("std::vector<int> & v", "std::vector v"), ("int x = 3", "int x")])
def test_clean_param(spark, text, want):
    assert value(spark, P.clean_param(F.lit(text))) == want


def test_common_level(spark):
    assert value(spark, X.common_level(F.lit("/a/b/c.go"), F.lit("/a/d/e.go"))) == 2
    assert value(spark, X.common_level(F.lit("/a/b/c.go"), F.lit("/a/b/e.go"))) == 3
