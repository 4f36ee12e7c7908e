"""Hand-computed cases of the index, query, queue and status operators."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import times, validators
from loomgraph.operators import callgraph, definitions, diffs, events, index, mutations, references, status, text, tree, workspaces


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns or df.columns).collect())


ELEMENTS = "path string, language string, ordinal int, name string, element_type string, is_definition boolean, sl int, sc int, el int, ec int, arity int, var_args boolean"


def element(path, ordinal, kind, name, sl, el, arity, variadic=False):
    return (path, "go", ordinal, name, kind, kind in ("FUNCTION", "METHOD"), sl, 0, el, 1, arity, variadic)


@pytest.fixture(scope="module")
def graph(spark):
    made = [
        element("/p/a.go", 1, "FUNCTION", "main", 0, 10, 0), element("/p/a.go", 2, "CALL", "f", 2, 2, 1), element("/p/a.go", 3, "CALL", "g", 3, 3, 2), element("/p/a.go", 4, "CALL", "f", 4, 4, 1),
        element("/p/a.go", 5, "FUNCTION", "f", 12, 20, 1), element("/p/a.go", 6, "CALL", "g", 14, 14, 2),
        element("/q/b.go", 1, "FUNCTION", "g", 0, 5, 2), element("/q/b.go", 2, "CALL", "f", 2, 2, 1), element("/q/b.go", 3, "FUNCTION", "h", 7, 9, 1, True),
        element("/r/c.go", 1, "METHOD", "k", 0, 5, 0), element("/r/c.go", 2, "CALL", "h", 1, 1, 3), element("/r/c.go", 3, "CALL", "h", 2, 2, 0), element("/r/c.go", 4, "CALL", "f", 3, 3, 2),
    ]
    elements = spark.createDataFrame(made, ELEMENTS).cache()
    imports = spark.createDataFrame([("/r/c.go", "q.b", "q.b")], "path string, name string, source string")
    return elements, imports, callgraph.call_edges(elements).cache()


def test_edges(graph):
    want = [("f", "g"), ("f", "k"), ("f", "main"), ("f", "main"), ("g", "f"), ("g", "main"), ("h", "k"), ("h", "k")]
    assert rows(graph[2], "callee", "caller") == want


def call_graph(graph, name, **options):
    elements, imports, edges = graph
    roots = elements.where((F.col("name") == name) & F.col("is_definition")).withColumn("params", F.col("arity"))
    return callgraph.reverse_call_graph(edges, imports, roots, **options)


def test_graph_of_f(graph):
    got = [(r["name"], r["depth"], r["parent_name"]) for r in call_graph(graph, "f").collect()]
    assert sorted(got, key=str) == sorted([("f", 0, None), ("main", 1, "f"), ("main", 1, "f"), ("g", 1, "f")], key=str)
    scores = {(r["name"], r["score"]) for r in call_graph(graph, "f").where("depth = 1").collect()}
    assert ("main", 100) in scores
    assert all(score < 50 for name, score in scores if name == "g")


def test_graph_of_h_and_main(graph):
    assert rows(call_graph(graph, "h"), "name", "depth", "score")[1:] == [("k", 1, 50)]
    assert [r["name"] for r in call_graph(graph, "main").collect()] == ["main"]


def test_top_callers_limit(spark, graph):
    many = [element(f"/m/f{i:02d}.go", 1, "FUNCTION", f"c{i:02d}", 0, 3, 1) for i in range(15)] + [element(f"/m/f{i:02d}.go", 2, "CALL", "t", 1, 1, 1) for i in range(15)]
    elements = spark.createDataFrame([element("/z/t.go", 1, "FUNCTION", "t", 0, 1, 1), *many], ELEMENTS)
    callee = elements.where("name = 't' and is_definition").select(F.col("path").alias("c_path"), F.col("name").alias("c_name"), F.col("arity").alias("c_params"), F.col("var_args").alias("c_var_args"))
    got = callgraph.ranked_callers(callgraph.call_edges(elements), graph[1], callee)
    assert rows(got, "rank") == [(i,) for i in range(1, 11)]


def test_reachable(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "callee string, caller string")
    got = callgraph.reachable_callers(edges, spark.createDataFrame([("a",)], "name string"), max_layer=5)
    assert rows(got) == [("a", "a", 0), ("a", "b", 1), ("a", "c", 2), ("a", "d", 3)]


def test_hash_diff(spark):
    local = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, hash string")
    remote = spark.createDataFrame([("b", "2"), ("c", "9"), ("d", "4")], "path string, hash string")
    assert rows(diffs.tree_diff(local, remote)) == [("a", "add", "1"), ("c", "modify", "3"), ("d", "delete", "")]
    assert rows(diffs.tree_diff(local, remote, deletes=False)) == [("a", "add", "1"), ("c", "modify", "3")]
    assert rows(diffs.overlay(local, remote)) == [("a", "1"), ("b", "2"), ("c", "9"), ("d", "4")]


def test_quota(spark):
    made = [("A", i, 0, 5) for i in range(30)] + [("B", 30 + i, 0, 5 if i else 900) for i in range(10)]
    got = definitions.with_content_quota(spark.createDataFrame(made, "name string, ordinal int, sl int, el int"))
    assert rows(got.where("has_content").groupBy("name", "cap").count()) == [("A", 15, 15), ("B", 5, 5)]
    one = [("A", 0, 0, 1)] + [("B", i, 0, 1) for i in range(1, 41)]
    caps = definitions.with_content_quota(spark.createDataFrame(one, "name string, ordinal int, sl int, el int"))
    assert rows(caps.select("name", "cap").distinct()) == [("A", 0), ("B", 20)]


def test_last_root_and_references(graph):
    elements = graph[0]
    assert rows(references.references(elements, elements.where("name = 'f' and is_definition")), "path", "sl") == [("/p/a.go", 2), ("/p/a.go", 4), ("/q/b.go", 2), ("/r/c.go", 3)]
    twice = elements.where("is_definition").unionByName(elements.where("name = 'f' and is_definition").withColumn("ordinal", F.lit(99)).withColumn("sl", F.lit(70)))
    assert ("f", 70) in rows(references.last_roots(twice), "name", "sl")
    assert ("f", 12) not in rows(references.last_roots(twice), "name", "sl")


PATHS = [("/w/d/a.go",), ("/w/d/e/b.go",), ("/w/dx/c.go",)]


def test_remove_and_rename(spark):
    files = spark.createDataFrame(PATHS, "path string").withColumn("language", F.lit("go"))
    assert rows(index.remove_paths(files, ["/w/d"]), "path") == [("/w/dx/c.go",)]
    assert rows(index.lookup(files, "/w/d"), "path") == [("/w/d/a.go",), ("/w/d/e/b.go",)]
    assert rows(index.lookup(files, "/w/d/a.go"), "path") == [("/w/d/a.go",)]
    moved = index.rename_paths(files, "/w/d", "/w/n")
    assert rows(moved, "path") == [("/w/dx/c.go",), ("/w/n/a.go",), ("/w/n/e/b.go",)]
    assert rows(index.rename_paths(moved, "/w/n", "/w/d"), "path") == sorted(PATHS)
    assert rows(index.rename_paths(files, "/w/d/a.go", "/w/d/a.py"), "path", "language")[0] == ("/w/d/a.py", "python")


def test_remove_undoes_index(spark):
    old = spark.createDataFrame([("/a", 1), ("/b", 1)], "path string, n int")
    new = spark.createDataFrame([("/c", 2), ("/a", 2)], "path string, n int")
    merged = index.reindexed(old, new)
    assert rows(merged) == [("/a", 2), ("/b", 1), ("/c", 2)]
    assert rows(index.remove_files(index.reindexed(old, new.where("path = '/c'")), new.where("path = '/c'"))) == rows(old)
    assert rows(index.upsert(old, new, "path")) == rows(merged)


QUEUE = "id bigint, workspace string, event_type string, path string, target string, sync_id string, embedding_status int, codegraph_status int, created_at timestamp_ntz, updated_at timestamp_ntz"


def event(i, kind, path, emb, cg, at, workspace="/w"):
    return (i, workspace, kind, path, f"{path}2", "", emb, cg, at, at)


T1, T2 = datetime(2024, 1, 1, 10), datetime(2024, 1, 1, 11)


def test_scan_plan(spark):
    def plan(emb, status_):
        queue = spark.createDataFrame([event(1, "add_file", "x", 6, 4, T1), event(2, "modify_file", "x", emb, 4, T2)], QUEUE)
        changes = spark.createDataFrame([("/w", "x", status_), ("/w", "y", "add")], "workspace string, path string, status string")
        return [r["action"] for r in events.scan_plan(changes, queue).orderBy("path").collect()]

    assert plan(3, "modify") == ["skip", "create"]
    assert plan(3, "delete") == ["create", "create"]
    assert plan(1, "delete") == ["update", "create"]


def test_latest_breaks_ties_by_id(spark):
    queue = spark.createDataFrame([event(5, "add_file", "x", 1, 1, T1), event(4, "delete_file", "x", 1, 1, T1)], QUEUE)
    assert rows(events.latest(queue), "id") == [(5,)]


def test_drain_order(spark):
    kinds = ["rename_file", "add_file", "rebuild_workspace", "delete_file", "close_workspace"]
    queue = spark.createDataFrame([event(i, kinds[i % 5], f"p{i}", 1, 1, T1) for i in range(100)], QUEUE)
    got = events.drained(queue).orderBy("priority", "rn").collect()
    assert [r["event_type"] for r in got[::10]] == ["rebuild_workspace", "add_file", "delete_file", "rename_file"]
    assert len(got) == 40


def test_timeouts_and_expiry(spark):
    now = F.lit(datetime(2024, 1, 3, 10)).cast("timestamp_ntz")
    queue = spark.createDataFrame([event(1, "add_file", "a", 2, 2, T1), event(2, "add_file", "b", 3, 4, datetime(2024, 1, 3, 9, 59)), event(3, "add_file", "c", 6, 4, T2)], QUEUE)
    assert rows(events.timed_out(queue, now)) == [(1, "codegraph", 3), (1, "embedding", 4)]
    assert rows(events.expired(queue, now), "id") == []  # exactly 48 hours are not yet expired
    assert rows(events.expired(queue, now + F.expr("interval 1 second")), "id") == [(1,)]


def test_merge_and_fold(spark):
    queue = spark.createDataFrame([event(1, "add_file", "a", 3, 4, T1), event(2, "rename_file", "b", 3, 4, T1)], QUEUE)
    updates = spark.createDataFrame([(1, "s", 0), (2, "", 5)], "id bigint, sync_id string, embedding_status int")
    assert rows(events.merged(queue, updates), "id", "sync_id", "embedding_status") == [(1, "s", 3), (2, "", 5)]
    stamped = events.merged(queue, updates, F.lit(T2))
    assert rows(stamped.where("id = 1"), "updated_at") == [(T2,)]
    sync = queue.select("workspace", "sync_id").first()
    remote = spark.createDataFrame([(sync["workspace"], sync["sync_id"], "a", "failed"), (sync["workspace"], sync["sync_id"], "b2", "unsupported"), ("/other", sync["sync_id"], "a", "completed"), (sync["workspace"], "later", "a", "completed")], "workspace string, sync_id string, path string, status string")
    assert rows(events.remote_fold(queue, remote)) == [(1, 5), (2, 6)]  # answers of other workspaces and uploads don't count


def test_queue_changes(spark):
    queue = spark.createDataFrame([event(5, "add_file", "a", 6, 4, T1), event(9, "add_file", "b", 6, 4, T2)], QUEUE)
    new = spark.createDataFrame([("/w", "z", "add_file"), ("/v", "y", "add_file"), ("/v", "x", "delete_file")], "workspace string, path string, event_type string")
    made = events.inserted(queue, new, F.lit(T2))
    assert rows(made.where("id > 9"), "id", "workspace", "path") == [(10, "/v", "x"), (11, "/v", "y"), (12, "/w", "z")]
    assert rows(events.deleted(queue, queue.where("id = 5")), "id") == [(9,)]
    now = F.lit(datetime(2024, 1, 20)).cast("timestamp_ntz")
    assert events.retained(queue, now).count() == 0  # all succeeded
    assert rows(events.published(queue, F.col("file") == "a"), "id") == [(9,)]


def test_rename_leaves_other_rows_alone(spark):
    files = spark.createDataFrame([("/ws/a/x.go", "go"), ("/ws/moved2/y.h", "c"), ("/ws/moved/z.h", "c")], "path string, language string")
    got = index.rename_paths(files, "/ws/a", "/ws/moved")
    assert rows(got) == [("/ws/moved/x.go", "go"), ("/ws/moved/z.h", "c"), ("/ws/moved2/y.h", "c")]


def test_index_programs(spark):
    files = spark.createDataFrame([("/w/a.py", 1, "def f(x): return g(x)"), ("/w/d/b.py", 1, "y = 1"), ("/w/d/c.txt", 1, "-")], "path string, ts long, content string")
    first = mutations.index_workspace(files)
    names = lambda made: rows(made.elements, "path", "name")
    assert names(first) == [("/w/a.py", "f"), ("/w/a.py", "g"), ("/w/d/b.py", "y")]
    later = spark.createDataFrame([("/w/a.py", 1, "def never_read(): pass"), ("/w/d/b.py", 2, "z = 2")], "path string, ts long, content string")
    second = mutations.index_workspace(later, first)
    assert names(second) == [("/w/a.py", "f"), ("/w/a.py", "g"), ("/w/d/b.py", "z")]
    assert rows(second.files, "path") == [("/w/a.py",), ("/w/d/b.py",)]
    assert names(mutations.removed(second, spark.createDataFrame([("/w/d/",)], "path string"))) == [("/w/a.py", "f"), ("/w/a.py", "g")]
    moves = spark.createDataFrame([("/w", "/v"), ("/w/d", "/u")], "path string, target string")
    assert names(mutations.renamed(second, moves)) == [("/u/b.py", "z"), ("/v/a.py", "f"), ("/v/a.py", "g")]
    events_ = spark.createDataFrame([("rebuild_workspace", "", ""), ("delete_file", "/w/a.py", ""), ("rename_file", "/w/d/b.py", "/w/e.py")], "event_type string, path string, target string")
    assert names(mutations.applied(first, events_, later)) == [("/w/e.py", "z")]
    assert rows(mutations.of_projects(spark.createDataFrame([("/a/b/c",), ("x",)], "path string"), spark.createDataFrame([("/a",), ("/a/b",), ("/a/b/c",), ("/ab",)], "root string"))) == [("/a/b/c", "/a"), ("/a/b/c", "/a/b")]


def test_workspaces(spark):
    table = spark.createDataFrame([("/w", "true", 5, 2, T1, T1), ("/v", "false", 3, 3, T2, T2)], "workspace string, active string, file_num long, done long, created_at timestamp_ntz, updated_at timestamp_ntz")
    new = spark.createDataFrame([("/u",), ("/w",)], "workspace string")
    assert rows(workspaces.created(table, new), "workspace") == [("/u",), ("/v",), ("/w",)]
    changed = workspaces.updated(table, spark.createDataFrame([("/w", None, 9)], "workspace string, active string, file_num long"), F.lit(T2))
    assert rows(changed.where("workspace = '/w'"), "active", "file_num", "updated_at") == [("true", 9, T2)]
    assert rows(workspaces.listed(table, 1), "workspace") == [("/v",)]
    queue = spark.createDataFrame([event(1, "add_file", "a", 1, 1, T1), event(2, "add_file", "b", 2, 2, T1)], QUEUE)
    after, left = workspaces.switched(table, queue, spark.createDataFrame([("/w", "false"), ("/v", "true")], "workspace string, active string"), F.lit(T2))
    assert rows(after, "workspace", "active") == [("/v", "true"), ("/w", "false")]
    assert rows(left, "workspace", "event_type") == [("/v", "open_workspace"), ("/w", "add_file")]
    assert callgraph.bounded_layers(None) == callgraph.bounded_layers(0) == 5
    assert callgraph.bounded_layers(99) == 10


def test_paths_that_clients_send(spark):
    value = lambda c: spark.range(1).select(c).first()[0]
    assert [value(validators.sanitised_path(F.lit(p))) for p in ("", "a//b/./c", "/a/../b", "../x", "/../x", "a/../../b")] == ["", "/a/b/c", "/b", None, "/x", None]
    assert [value(validators.valid_path(F.lit(p))) for p in ("", "a/b", "a/../b", "~x", "a\\b", "x" * 1025)] == [False, True, False, False, False, False]
    assert value(times.upload_timeout(F.lit(5 * 1024 * 1024))) == 60
    assert value(times.upload_timeout(F.lit(10 * 1024 * 1024))) == 85
    assert value(times.upload_timeout(F.lit(10**10))) == 600


@pytest.mark.parametrize(
    ("done", "total", "states", "want"),
    [(199, 200, [1], (99.5, "running")), (199, 200, [3], (99.5, "success")), (100, 200, [3], (50.0, "failed")), (200, 200, [1], (100.0, "success")), (0, 0, [], (0.0, "pending")), (10, 200, [], (5.0, "success"))],
)
def test_status(spark, done, total, states, want):
    workspaces = spark.createDataFrame([("/w", total, done)], "workspace string, file_num long, done long")
    queue = spark.createDataFrame([event(i, "add_file", "x", 6, s, T1) for i, s in enumerate(states)], QUEUE)
    assert tuple(status.status(workspaces, queue).first())[1:] == want


def test_counts(spark):
    queue = spark.createDataFrame([event(1, "add_file", "a", 6, 4, T1), event(2, "add_file", "a", 1, 4, T1, "/v")], QUEUE)
    assert status.counts_by_type(queue, []).first()["n"] == 0
    assert status.counts_by_type(queue, ["add_file"]).first()["n"] == 2
    assert rows(status.all_succeeded(queue)) == [("/v", False), ("/w", True)]


def test_text(spark):
    content = F.lit("  import (\r\n    a\n\n  b )\nfunc f() {\n}")
    value = lambda c: spark.range(1).select(c).first()[0]
    assert value(text.read_lines(content, F.lit(2), F.lit(4))) == "    a\n\n  b )"
    assert value(text.read_lines(content, F.lit(0), F.lit(1))) == "  import ("
    assert value(text.import_text(content, F.lit(0), F.lit(3))) == "import ( a b )"
    assert value(text.signature(content, F.lit(4), F.lit("f"))) == "func f() {"
    assert value(text.signature(content, F.lit(40), F.lit("f"))) == "f"
    assert value(text.snippet_end(F.lit(10), F.lit(5))) == 10
    assert value(text.snippet_end(F.lit(10), F.lit(5000))) == 510


def test_tree(spark):
    files = spark.createDataFrame([("/w/a/b.go", 5), ("/w/a/c/d.go", 7), ("/w/.git/x", 1)], "path string, size long")
    nodes = tree.tree_nodes(files, root="/w")
    assert rows(nodes) == [("a", "", 1, True), ("a/b.go", "a", 2, False), ("a/c", "a", 2, True), ("a/c/d.go", "a/c", 3, False)]
    assert rows(tree.children(nodes, "a")) == [("b.go", False), ("c", True)]
    assert rows(tree.tree_nodes(files, root="/w", max_depth=1)) == [("a", "", 1, True)]
    assert ("/w/a", 1, 5) in rows(tree.folder_totals(files))


def test_empty_tables(spark):
    none = spark.createDataFrame([], ELEMENTS)
    imports = spark.createDataFrame([], "path string, name string, source string")
    assert callgraph.call_edges(none).count() == 0
    roots = none.withColumn("params", F.col("arity"))
    assert callgraph.reverse_call_graph(callgraph.call_edges(none), imports, roots).count() == 0
    assert index.symbol_table(none).count() == 0
