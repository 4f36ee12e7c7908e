"""Call edges, and the reverse call graph of a set of definitions."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.params import arity_fits
from ..functions.scores import callee_facts, caller_facts, match_facts
from ..session import checkpoint_folder

CALLERS = 10
#: Most files whose imports are broadcast, and most names and sources of theirs (some 50 bytes each).
BROADCAST_FILES, BROADCAST_IMPORTS = 100_000, 1_000_000
_KEY = ("path", "name", "sl", "sc", "el", "ec")


def call_edges(elements: DataFrame) -> DataFrame:
    """(callee, args, caller.., site..): each call with every function or method whose lines contain it.

    An equi-join on the file; the containment is its residual condition, as files are small.
    """
    caller = elements.where(F.col("element_type").isin("FUNCTION", "METHOD"))
    caller = caller.select(F.col("path"), F.col("name").alias("caller"), "sl", "sc", "el", "ec", F.col("arity").alias("params"), F.col("var_args"))
    call = elements.where("element_type = 'CALL'").select(F.col("path").alias("call_path"), F.col("name").alias("callee"), F.col("arity").alias("args"), F.col("sl").alias("call_sl"), F.col("sc").alias("call_sc"), F.col("el").alias("call_el"))
    on = (F.col("path") == F.col("call_path")) & (F.col("call_sl") >= F.col("sl")) & (F.col("call_el") <= F.col("el"))
    return caller.join(call, on).select("callee", "args", "caller", "path", "sl", "sc", "el", "ec", "params", "var_args", "call_sl", "call_sc")


def callee_map(edges: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Per callee, or per callee in ``names`` (callee), its number of call sites and the distinct callers."""
    edges = edges if names is None else edges.join(names.select("callee").distinct(), "callee", "left_semi")
    return edges.groupBy("callee").agg(F.count(F.lit(1)).alias("sites"), F.array_sort(F.collect_set("caller")).alias("callers"))


def ranked_callers(edges: DataFrame, imports: DataFrame, callees: DataFrame, most: int | None = CALLERS) -> DataFrame:
    """For each definition in callees (columns c_path, c_name, c_params, c_var_args and further ones) its calls by score.

    A call fits if its number of arguments does.  Ties in the score go by path, position and name.
    What the score takes from a file is made once for each call and each definition, on their own
    sides of the join; a pair only compares it.  The imports of up to BROADCAST_FILES files, and
    BROADCAST_IMPORTS in all, meet the pairs in place; more are joined with the calls before that.
    """
    named = imports.select(F.col("path").alias("ipath"), F.explode(F.array("name", "source")).alias("imported")).groupBy("ipath").agg(F.collect_set("imported").alias("imported"))
    files, names = named.agg(F.count(F.lit(1)), F.sum(F.size("imported"))).first()
    few = files <= BROADCAST_FILES and (names or 0) <= BROADCAST_IMPORTS
    sites = edges.withColumn("file", caller_facts(F.col("path")))
    if not few:
        sites = sites.join(named, F.col("path") == F.col("ipath"), "left").drop("ipath")
    of = callees.columns
    called = callees.withColumn("c_file", callee_facts(F.col("c_path")))
    fits = (F.col("callee") == F.col("c_name")) & arity_fits(F.col("args"), F.col("c_params"), F.col("c_var_args"))
    found = sites.join(called, fits)
    if few:
        found = found.join(F.broadcast(named), F.col("path") == F.col("ipath"), "left").drop("ipath")
    found = found.withColumn("score", match_facts(F.col("path"), F.col("file"), F.col("c_path"), F.col("c_file"), F.col("imported"))).drop("imported", "file", "c_file")
    order = [F.desc("score"), "path", "sl", "sc", "caller", "call_sl", "call_sc"]
    # paths begin alike: rows are sorted by a hash of the definition first, which tells most of them apart at once
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy(F.xxhash64(*of), *of).orderBy(*order)))
    return found if most is None else found.where(F.col("rank") <= most)


def bounded_layers(asked: int | None, default: int = 5, most: int = 10) -> int:
    """Layers of a query: ``default`` where none or no positive number is asked for, ``most`` at most."""
    return min(asked, most) if asked and asked > 0 else default


def reverse_call_graph(edges: DataFrame, imports: DataFrame, roots: DataFrame, *, max_layer: int = 3, most: int = CALLERS, faithful: bool = False) -> DataFrame:
    """Layers of callers above the roots: one row for each node.

    roots: path, name, sl, sc, el, ec, params, var_args.  Rows: those columns of the caller, depth
    (roots: 0), parent_path, parent_name, parent_sl, score and rank among the parent's callers.
    A caller that was reached in an earlier layer isn't reached again; within a layer the first
    parent (by path, position, name) has it, once for each call site.  The first layer is not
    limited, later ones give each parent ``most`` callers.  ``faithful``: callers are no longer
    variadic when they become parents, as in an index that doesn't store it.

    A layer begins with the calls of its parents' names, so that the visited set only meets these;
    at most 10 layers are made.
    """
    checkpoint_folder(roots.sparkSession)
    none = F.lit(None)
    layer = roots.select(*_KEY, "params", "var_args").distinct().withColumns({"depth": F.lit(0), "parent_path": none.cast("string"), "parent_name": none.cast("string"), "parent_sl": none.cast("int"), "score": none.cast("int"), "rank": F.lit(1)})
    out = layer = layer.checkpoint()
    visited = layer.select(*_KEY)
    edges = edges.persist(StorageLevel.DISK_ONLY)  # each layer reads them
    for depth in range(1, bounded_layers(max_layer) + 1):
        parents = layer.select(*[F.col(c).alias(f"c_{c}") for c in (*_KEY, "params", "var_args")]).distinct()
        if faithful and depth > 1:
            parents = parents.withColumn("c_var_args", F.lit(False))
        near = edges.join(parents.select(F.col("c_name").alias("callee")).distinct(), "callee", "left_semi")
        new = near.withColumn("name", F.col("caller")).join(visited.distinct(), list(_KEY), "left_anti")
        found = ranked_callers(new, imports, parents, None if depth == 1 else most)
        parent = F.struct("c_path", "c_sl", "c_sc", "c_name")
        first = F.min(parent).over(Window.partitionBy(*_KEY))
        found = found.withColumn("first", first).where(F.col("first") == parent)
        layer = found.select(*_KEY, "params", "var_args", F.lit(depth).alias("depth"), F.col("c_path").alias("parent_path"), F.col("c_name").alias("parent_name"), F.col("c_sl").alias("parent_sl"), "score", "rank").checkpoint()
        if layer.isEmpty():
            break
        out, visited = out.unionByName(layer), visited.unionByName(layer.select(*_KEY))
    edges.unpersist()
    return out


def reachable_callers(edges: DataFrame, roots: DataFrame, *, max_layer: int = 3) -> DataFrame:
    """(root, name, depth): the least number of calls from name to root, without scores and arity.

    edges: callee, caller.  A loop of joins that keeps only names not seen before.
    """
    checkpoint_folder(roots.sparkSession)
    pairs = edges.select("callee", "caller").distinct()
    out = layer = roots.select(F.col("name").alias("root"), "name", F.lit(0).alias("depth")).distinct()
    for depth in range(1, max_layer + 1):
        found = layer.join(pairs, F.col("name") == F.col("callee")).select("root", F.col("caller").alias("name")).distinct()
        layer = found.join(out.select("root", "name"), ["root", "name"], "left_anti").withColumn("depth", F.lit(depth)).checkpoint()
        if layer.isEmpty():
            break
        out = out.unionByName(layer)
    return out
