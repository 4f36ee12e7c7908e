"""The registered queries of the code index, each with its DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import imports as I
from ..functions import params as P
from ..functions import paths as X
from ..functions import ranges as R
from ..functions import scores as S
from ..operators import callgraph, definitions, diffs, events, index, mutations, references, status, text, tree
from ..sources import extract, samples
from .views import table, with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query; its function gets a reader of model tables."""

    def keep(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda name: table(spark, sf_dir, name))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            ORACLE_SQL[f.__name__] = with_views(sql)
        return f

    return keep


_INFER = r"""CASE regexp_extract(path, '(\.[^./]*)$', 1) WHEN '.go' THEN 'go' WHEN '.java' THEN 'java' WHEN '.py' THEN 'python' WHEN '.js' THEN 'javascript' WHEN '.ts' THEN 'typescript' WHEN '.tsx' THEN 'typescript' WHEN '.h' THEN 'cpp' WHEN '.cpp' THEN 'cpp' END"""


# scans, paths and filters


@query(f" SELECT doc_id, path, {_INFER} AS language FROM files")
def scan_language_infer(t):
    return t("files").select("doc_id", "path", X.infer_language(F.col("path")).alias("language"))


@query(r" SELECT doc_id, path FROM files WHERE regexp_extract(path, '(\.[^./]*)$', 1) IN ('.go', '.py', '.tsx') AND NOT regexp_matches(path, '/d1[^/]*$')")
def filter_visit_pattern(t):
    skips = X.visit_skips(F.col("path"), F.lit(False), exclude_exts=(".h",), include_exts=(".go", ".py", ".tsx"), exclude_dirs=("node_modules",), exclude_prefixes=("d1",))
    return t("files").where(~skips).select("doc_id", "path")


@query(" SELECT doc_id, regexp_matches(path, '(^|/)\\.[^/]*[^./][^/]*(/|$)') AS hidden FROM files")
def filter_hidden_path(t):
    return t("files").select("doc_id", X.is_hidden(F.col("path")).alias("hidden"))


@query(" SELECT doc_id, starts_with(path, '/ws/src1/') AS below FROM files")
def filter_subdir(t):
    return t("files").select("doc_id", X.is_subdir(F.lit("/ws/src1"), F.col("path")).alias("below"))


@query(" SELECT a.doc_id, regexp_replace(a.path, '/[^/]*$', '') = regexp_replace(b.path, '/[^/]*$', '') AS same_dir FROM files a JOIN files b ON b.doc_id = a.doc_id + 1")
def filter_same_dir(t):
    a, b = t("files").select("doc_id", "path"), t("files").select((F.col("doc_id") - 1).alias("doc_id"), F.col("path").alias("next"))
    return a.join(b, "doc_id").select("doc_id", X.same_parent(F.col("path"), F.col("next")).alias("same_dir"))


@query(" SELECT path, ts FROM files f WHERE NOT EXISTS (SELECT 1 FROM old_index o WHERE o.path = f.path AND o.ts = f.ts)")
def filter_incremental_changed(t):
    return index.changed_files(t("files").select("path", "ts"), t("old_index"))


@query(" SELECT doc_id, path FROM files WHERE starts_with(path, '/ws/src3/en/')")
def prefix_scan(t):
    return t("files").where(X.under(F.col("path"), F.lit("/ws/src3/en"))).select("doc_id", "path")


_ASKED = "(SELECT min(path) FROM files)"


@query(f""" WITH keyed AS (SELECT path FROM files UNION ALL SELECT concat({_ASKED}, '/below') UNION ALL SELECT '/ws/src2')
SELECT path, 'folder' AS asked FROM keyed WHERE starts_with(path, '/ws/src1/') UNION ALL SELECT path, 'file' FROM keyed WHERE path = {_ASKED} UNION ALL SELECT path, 'both' FROM keyed WHERE path = '/ws/src2'""")
def lookup_exact_or_prefix(t):
    files = t("files").select("path")
    first = files.agg(F.min("path")).first()[0]
    keyed = files.unionByName(files.sparkSession.createDataFrame([(f"{first}/below",), ("/ws/src2",)], "path string"))
    asked = {"folder": "/ws/src1", "file": first, "both": "/ws/src2"}
    found = [index.lookup(keyed, target).withColumn("asked", F.lit(name)) for name, target in asked.items()]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query(r""" SELECT DISTINCT e.path, p.project FROM elements e JOIN projects p ON starts_with(e.path, concat(p.root, '/'))""")
def file_to_project(t):
    return mutations.of_projects(t("elements"), t("projects")).join(t("projects"), "root").select("path", "project")


@query(" SELECT DISTINCT path, concat('ws_', left(sha256(path), 32)) AS project_id, concat(regexp_extract(path, '[^/]*$'), '_', md5(path)) AS codebase_id FROM elements")
def path_ids(t):
    path = F.col("path")
    return t("elements").select("path").distinct().select("path", X.project_id(F.lit("ws"), path).alias("project_id"), X.codebase_id(path).alias("codebase_id"))


@query(" SELECT id, CASE WHEN starts_with(path, concat(workspace, '/')) THEN path ELSE concat(workspace, path) END AS full_path FROM queue")
def event_full_path(t):
    return t("queue").select("id", X.absolute(F.col("workspace"), F.col("path")).alias("full_path"))


# ranges, parameters, scores


@query(" SELECT path, ordinal, sl + 1 AS start_line, sc + 1 AS start_column, el + 1 AS end_line, ec + 1 AS end_column, CASE WHEN sl = el THEN sl + 1 ELSE el + 1 END AS short_end FROM elements")
def proj_range_to_position(t):
    p = R.position(F.array("sl", "sc", "el", "ec"))
    short = R.position(F.when(F.col("sl") == F.col("el"), F.array("sl", "sc", "ec")).otherwise(F.array("sl", "sc", "el", "ec")))
    return t("elements").select("path", "ordinal", *[p[c].alias(c) for c in ("start_line", "start_column", "end_line", "end_column")], short["end_line"].alias("short_end"))


@query(" SELECT path, ordinal, greatest(sl, 1) AS first_line, CASE WHEN greatest(el, greatest(sl, 1)) - greatest(sl, 1) + 1 > 200 THEN greatest(sl, 1) + 199 ELSE greatest(el, greatest(sl, 1)) END AS last_line FROM elements")
def proj_line_range(t):
    r = R.line_range(F.col("sl"), F.col("el"), 200)
    return t("elements").select("path", "ordinal", r[0].alias("first_line"), r[1].alias("last_line"))


@query(" SELECT path, ordinal, CASE WHEN var_args AND arity > 0 THEN arity - 1 ELSE arity END AS param_count, var_args AND arity > 0 AS is_variadic FROM elements")
def proj_param_count(t):
    names = F.transform(F.when(F.col("arity") > 0, F.sequence(F.lit(1), F.col("arity"))).otherwise(F.array().cast("array<int>")), lambda i: F.struct(F.when(F.col("var_args") & (i == F.col("arity")), "...rest").otherwise(F.concat(F.lit("a"), i)).alias("name")))
    return t("elements").withColumn("params", names).select("path", "ordinal", P.param_count(F.col("params")).alias("param_count"), P.is_variadic(F.col("params")).alias("is_variadic"))


@query(""" SELECT path, ordinal, element_type IN ('FUNCTION', 'METHOD', 'VARIABLE') AS is_definition,
  CASE element_type WHEN 'FUNCTION' THEN 'definition.function' WHEN 'METHOD' THEN 'definition.method' WHEN 'CALL' THEN 'call.method' WHEN 'REFERENCE' THEN 'reference' ELSE 'variable' END AS shown,
  CASE element_type WHEN 'CALL' THEN 'definition.method' WHEN 'REFERENCE' THEN 'definition.class' END AS looked_up FROM elements""")
def proj_element_types(t):
    shown = X.mapped(P.SHOWN_KIND, F.col("element_type"))
    return t("elements").select("path", "ordinal", F.col("element_type").isin(*P.DEFINITIONS).alias("is_definition"), shown.alias("shown"), X.mapped(P.DEFINITION_KIND, shown).alias("looked_up"))


_GRAMS = "CASE WHEN length({a}) >= 2 THEN list_distinct(list_transform(range(1, length({a})), lambda i: substring({a}, i, 2))) ELSE CAST([] AS VARCHAR[]) END"
_DICE = """CASE WHEN len({x}) + len({y}) > 0 THEN 2 * len(list_intersect({x}, {y}))::DOUBLE / (len({x}) + len({y})) ELSE (CASE WHEN {a} = {b} THEN 1.0 ELSE 0.0 END) END"""


@query(f""" WITH pairs AS (SELECT a.doc_id, regexp_replace(regexp_extract(a.path, '[^/]*$'), '\\.[^.]*$', '') AS a, regexp_replace(regexp_extract(b.path, '[^/]*$'), '\\.[^.]*$', '') AS b FROM files a JOIN files b ON b.doc_id = a.doc_id + 1),
  grams AS (SELECT *, {_GRAMS.format(a="a")} AS x, {_GRAMS.format(a="b")} AS y FROM pairs)
SELECT doc_id, round({_DICE.format(x="x", y="y", a="a", b="b")}, 6) AS dice FROM grams""")
def file_name_dice(t):
    a, b = t("files").select("doc_id", "path"), t("files").select((F.col("doc_id") - 1).alias("doc_id"), F.col("path").alias("next"))
    return a.join(b, "doc_id").select("doc_id", F.round(S.dice(X.stem(F.col("path")), X.stem(F.col("next"))), 6).alias("dice"))


@query(" SELECT name, count(*) AS n FROM (SELECT unnest(list_filter(list_transform(string_split(s, ','), lambda x: trim(regexp_extract(x, '[^.]*$'))), lambda x: length(x) > 0)) AS name FROM (SELECT concat('types.', name, ', ', language, ' ,x.y.', element_type, ',,') AS s FROM elements) z) z2 GROUP BY name")
def split_symbol_names(t):
    joined = F.concat(F.lit("types."), F.col("name"), F.lit(", "), F.col("language"), F.lit(" ,x.y."), F.col("element_type"), F.lit(",,"))
    return t("elements").select(F.explode(P.symbol_names(joined)).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


# imports

_NORM = r"CASE WHEN replace(translate({s}, '/\', '..'), '*', '') = '' THEN '.' ELSE replace(translate({s}, '/\', '..'), '*', '') END"


@query(f" SELECT p_partkey, {_NORM.format(s='source')} AS source, {_NORM.format(s='name')} AS name FROM raw_imports")
def proj_import_normalize(t):
    return t("raw_imports").select("p_partkey", I.normalise(F.col("source")).alias("source"), I.normalise(F.col("name")).alias("name"))


@query(""" SELECT p_partkey, CASE WHEN (language = 'go' AND name = 'fmt') OR (language = 'go' AND name = 'encoding/json') OR (language = 'java' AND name = 'java.util.List') OR (language = 'python' AND name = 'os.path')
    OR (language IN ('javascript', 'typescript') AND name = 'fs') OR (language = 'cpp' AND name IN ('<vector>', 'stdio.h')) OR (language = 'c' AND name = 'stdio.h') THEN 'system'
  WHEN (language = 'go' AND (name LIKE 'acme/%' OR name LIKE './%' OR name LIKE '../%')) OR (language = 'java' AND name LIKE 'acme%') OR (language = 'python' AND (name LIKE '.%' OR name LIKE 'acme.%'))
    OR (language IN ('c', 'cpp') AND contains(name, 'acme')) OR (language IN ('javascript', 'typescript') AND (name LIKE './%' OR name LIKE '../%')) THEN 'project' ELSE 'unknown' END AS kind FROM raw_imports""")
def package_classify(t):
    return t("raw_imports").select("p_partkey", I.classify_package(F.col("language"), F.col("name"), F.array(F.lit("acme"))).alias("kind"))


@query(""" SELECT p_partkey, concat(CASE WHEN source LIKE '../%' THEN '/ws/p/src' ELSE regexp_replace(file, '/[^/]*$', '') END, '/', CASE WHEN source LIKE '../%' THEN 'lib/y' ELSE 'util/x' END) AS resolved
FROM raw_imports WHERE source LIKE '.%'""")
def import_resolve_relative(t):
    return t("raw_imports").where("source like '.%'").select("p_partkey", X.resolve_relative(F.col("source"), F.col("file")).alias("resolved"))


@query(""" SELECT e.path, i.name, i.source, contains(translate(e.path, '/', '.'), i.name) OR contains(translate(e.path, '/', '.'), i.source) AS inside
FROM (SELECT DISTINCT path FROM elements) e JOIN imports i ON i.path = e.path""")
def filter_import_contains(t):
    files = t("elements").select("path").distinct()
    return files.join(t("imports"), "path").select("path", "name", "source", I.in_package(F.col("path"), F.col("name"), F.col("source")).alias("inside"))


# contents


@query(""" SELECT doc_id, array_to_string(list_slice(string_split(content, chr(10)), greatest(first_line, 1), CASE WHEN last_line <= 0 THEN 5000 ELSE last_line END), chr(10)) AS part FROM files""")
def read_line_range(t):
    return t("files").select("doc_id", text.read_lines(F.col("content"), F.col("first_line"), F.col("last_line")).alias("part"))


@query(""" SELECT doc_id, CASE WHEN length(trim(coalesce(string_split(content, chr(10))[first_line + 1], ''))) > 0 THEN substring(trim(string_split(content, chr(10))[first_line + 1]), 1, 200) ELSE 'none' END AS signature FROM files""")
def skeleton_signature(t):
    return t("files").select("doc_id", text.signature(F.col("content"), F.col("first_line").cast("int"), F.lit("none")).alias("signature"))


@query(""" SELECT doc_id, array_to_string(list_filter(list_transform(list_slice(string_split(content, chr(10)), first_line + 1, last_line + 1), lambda x: trim(x)), lambda x: length(x) > 0), ' ') AS import_text FROM files""")
def skeleton_import_text(t):
    return t("files").select("doc_id", text.import_text(F.col("content"), F.col("first_line").cast("int"), F.col("last_line").cast("int")).alias("import_text"))


@query(""" SELECT e.path, e.ordinal, CASE WHEN length(trim(coalesce(string_split(s.content, chr(10))[e.sl + 1], ''))) > 0 THEN substring(trim(string_split(s.content, chr(10))[e.sl + 1]), 1, 200) ELSE e.name END AS signature, e.sl + 1 AS start_line
FROM elements e JOIN source_texts s ON s.path = e.path""")
def file_skeleton(t):
    return text.skeleton(t("elements"), t("source_texts")).select("path", "ordinal", "signature", "start_line")


@query(""" SELECT path, parent, depth, max(is_dir) AS is_dir FROM (
  SELECT array_to_string(parts[1:d], '/') AS path, CASE WHEN d > 1 THEN array_to_string(parts[1:d - 1], '/') ELSE '' END AS parent, cast(d AS int) AS depth, d < len(parts) AS is_dir
  FROM (SELECT string_split(substring(path, 5), '/') AS parts, unnest(range(1, len(string_split(substring(path, 5), '/')) + 1)) AS d FROM files WHERE NOT contains(path, '/.')) a) b GROUP BY ALL""")
def dir_tree_nodes(t):
    return tree.tree_nodes(t("files"), root="/ws")


@query(" SELECT regexp_replace(path, '/[^/]*$', '') AS folder, count(*) AS files, cast(sum(size) AS bigint) AS bytes FROM files GROUP BY 1")
def dir_totals(t):
    return tree.folder_totals(t("files"))


# symbols, definitions, references


@query(" SELECT language, name, count(*) AS n, string_agg(concat(path, ':', cast(sl AS string)), ',' ORDER BY path, sl, sc, el, ec, element_type) AS places FROM symbols GROUP BY language, name")
def symbol_table(t):
    made = index.symbol_table(t("elements"))
    return made.select("language", "name", F.size("occurrences").cast("long").alias("n"), F.array_join(F.transform("occurrences", lambda o: F.concat_ws(":", o["path"], o["sl"])), ",").alias("places"))


@query(" SELECT name, language, path, sl, el, element_type FROM symbols WHERE name IN ('s1', 's17', 's100')")
def def_by_names(t):
    return definitions.by_names(t("symbols"), "a.s1, s17 ,,x.y.s100,s1").select("name", "language", "path", "sl", "el", "element_type")


_RANGES = "SELECT DISTINCT path, 20 AS start, 34 AS \"end\" FROM elements WHERE ordinal = 1"


@query(f""" WITH asked AS ({_RANGES}), inside AS (SELECT e.*, a.start, a."end" FROM elements e JOIN asked a ON e.path = a.path AND e.sl BETWEEN a.start AND a."end"),
  found AS (SELECT i.path, i.start, i."end", i.ordinal, i.name, s.path AS def_path, s.sl, s.el, s.element_type,
      (s.path = i.path OR regexp_replace(s.path, '/[^/]*$', '') = regexp_replace(i.path, '/[^/]*$', '')
        OR EXISTS (SELECT 1 FROM imports m WHERE m.path = i.path AND (contains(translate(s.path, '/', '.'), m.name) OR contains(translate(s.path, '/', '.'), m.source)))) AS seen
    FROM inside i JOIN symbols s ON s.language = i.language AND s.name = i.name WHERE NOT i.is_definition),
  flagged AS (SELECT *, max(seen::INT) OVER (PARTITION BY path, start, "end", ordinal) AS any_seen FROM found)
SELECT path, start, "end", name, path AS def_path, sl, el, element_type FROM inside WHERE is_definition
UNION ALL SELECT path, start, "end", name, def_path, sl, el, element_type FROM flagged WHERE seen OR any_seen = 0""")
def def_by_line_range(t):
    ranges = t("elements").where("ordinal = 1").select("path", F.lit(20).alias("start"), F.lit(34).alias("end"))
    return definitions.by_lines(t("elements"), t("imports"), t("symbols"), ranges)


@query(""" SELECT s.language, s.name, s.path, s.sl FROM symbols s JOIN (SELECT DISTINCT language, name FROM elements WHERE ordinal = 2 AND element_type = 'CALL') n ON n.language = s.language AND n.name = s.name
WHERE contains(translate(s.path, '/', '.'), 'pkg8.d') OR contains(translate(s.path, '/', '.'), 'p16.pkg')""")
def def_by_snippet(t):
    names = t("elements").where("ordinal = 2 and element_type = 'CALL'").select("language", "name")
    few = names.sparkSession.createDataFrame([("pkg8.d", "p16.pkg")], "name string, source string")
    return definitions.by_snippet(names, few, t("symbols")).select("language", "name", "path", "sl")


@query(""" WITH d AS (SELECT name, path, ordinal, sl, el, row_number() OVER (ORDER BY path, ordinal) AS o, count(*) OVER (PARTITION BY name) AS of_name, count(*) OVER () AS of_all FROM elements WHERE name IN ('s1', 's2', 's3', 's4') AND is_definition),
  c AS (SELECT *, cast(floor(of_name::DOUBLE / of_all * 20 + 0.5) AS bigint) AS cap, sum(CASE WHEN el - sl <= 200 THEN 1 ELSE 0 END) OVER (PARTITION BY name ORDER BY o ROWS UNBOUNDED PRECEDING) AS used FROM d)
SELECT name, path, ordinal AS place, cap, el - sl <= 200 AND used <= cap AS has_content FROM c""")
def def_content_quota(t):
    found = t("elements").where(F.col("name").isin("s1", "s2", "s3", "s4") & F.col("is_definition")).select("name", "path", F.col("ordinal").alias("place"), "sl", "el")
    found = found.withColumn("ordinal", F.struct("path", "place"))
    return definitions.with_content_quota(found).select("name", "path", "place", "cap", "has_content")


_LAST = """ WITH last_ AS (SELECT * FROM (SELECT path, name, sl, row_number() OVER (PARTITION BY path, name ORDER BY ordinal DESC) AS rn FROM elements WHERE is_definition) z WHERE rn = 1)"""


@query(" SELECT e.name, e.path, e.language, e.element_type, e.sl, e.sc, e.ec FROM elements e WHERE e.element_type IN ('CALL', 'REFERENCE') AND e.name IN (SELECT name FROM symbols WHERE element_type = 'METHOD')")
def refs_by_symbol(t):
    return references.references(t("elements"), t("symbols").where("element_type = 'METHOD'")).select("name", "path", "language", "element_type", "sl", "sc", "ec")


@query(_LAST + """ SELECT l.path AS root_path, l.name, l.sl AS root_sl, e.path, e.sl, e.sc, cast(row_number() OVER (PARTITION BY l.path, l.name ORDER BY e.path, e.sl, e.sc, e.ec) AS int) AS rank
FROM last_ l JOIN elements e ON e.name = l.name AND e.element_type IN ('CALL', 'REFERENCE')""")
def refs_last_root_wins(t):
    return references.reference_tree(t("elements"), t("elements").where("is_definition"))


@query(""" SELECT path, ordinal, name FROM elements WHERE is_definition AND path = (SELECT min(path) FROM elements) AND sl >= 0 AND el <= 60""")
def refs_roots_in_range(t):
    first = t("elements").agg(F.min("path")).first()[0]
    return references.roots_in(t("elements"), first, 0, 60).select("path", "ordinal", "name")


# calls

_EDGES = """edges_ AS (SELECT c.name AS callee, c.arity AS args, d.name AS caller, d.path, d.sl, d.sc, d.el, d.ec, d.arity AS params, d.var_args, c.sl AS call_sl, c.sc AS call_sc
  FROM elements d JOIN elements c ON d.path = c.path AND c.sl >= d.sl AND c.el <= d.el WHERE d.element_type IN ('FUNCTION', 'METHOD') AND c.element_type = 'CALL')"""


@query(f" WITH {_EDGES} SELECT * FROM edges_")
def call_edges(t):
    return callgraph.call_edges(t("elements"))


@query(f" WITH {_EDGES} SELECT callee, count(*) AS sites, array_to_string(list_sort(list_distinct(list(caller))), ',') AS callers FROM edges_ GROUP BY callee")
def callee_map(t):
    return callgraph.callee_map(callgraph.call_edges(t("elements"))).select("callee", "sites", F.array_join("callers", ",").alias("callers"))


_SCORED = f""" WITH {_EDGES}, scored AS (
  SELECT e.*, r.path AS c_path, r.sl AS c_sl, r.ordinal AS c_ordinal,
    regexp_replace(regexp_extract(e.path, '[^/]*$'), '\\.[^.]*$', '') AS a, regexp_replace(regexp_extract(r.path, '[^/]*$'), '\\.[^.]*$', '') AS b,
    EXISTS (SELECT 1 FROM imports m WHERE m.path = e.path AND (contains(translate(r.path, '/', '.'), m.name) OR contains(translate(r.path, '/', '.'), m.source))) AS imported
  FROM edges_ e JOIN elements r ON r.element_type IN ('FUNCTION', 'METHOD') AND e.callee = r.name AND CASE WHEN r.var_args THEN e.args >= r.arity ELSE e.args = r.arity END),
  grams AS (SELECT *, {_GRAMS.format(a="a")} AS x, {_GRAMS.format(a="b")} AS y FROM scored),
  final_ AS (SELECT *, CASE WHEN path = c_path THEN 100 WHEN regexp_replace(path, '/[^/]*$', '') = regexp_replace(c_path, '/[^/]*$', '') THEN 75 WHEN imported THEN 50
    ELSE 16 + cast(floor(10 * {_DICE.format(x="x", y="y", a="a", b="b")}) AS int) END AS score FROM grams),
  ranked AS (SELECT *, cast(row_number() OVER (PARTITION BY c_path, c_ordinal ORDER BY score DESC, path, sl, sc, caller, call_sl, call_sc) AS int) AS rank FROM final_)"""


@query(_SCORED + " SELECT c_path, c_ordinal, path, caller, sl, call_sl, score, rank FROM ranked WHERE rank <= 10")
def topn_callers(t):
    e = t("elements")
    callees = e.where("element_type in ('FUNCTION', 'METHOD')").select(F.col("path").alias("c_path"), F.col("ordinal").alias("c_ordinal"), F.col("name").alias("c_name"), F.col("arity").alias("c_params"), F.col("var_args").alias("c_var_args"))
    found = callgraph.ranked_callers(callgraph.call_edges(e), t("imports"), callees)
    return found.select("c_path", "c_ordinal", "path", "caller", "sl", "call_sl", "score", "rank")


@query(f""" WITH {_EDGES}, roots AS (SELECT * FROM elements WHERE element_type IN ('FUNCTION', 'METHOD') AND name = 's5'),
  callers AS (SELECT e.path, e.caller AS name, e.sl, e.sc, e.el, e.ec, r.path AS parent_path, r.name AS parent_name, r.sl AS parent_sl, r.sc AS psc,
      min(struct_pack(a := r.path, b := r.sl, c := r.sc)) OVER (PARTITION BY e.path, e.caller, e.sl, e.sc, e.el, e.ec) AS first_
    FROM edges_ e JOIN (SELECT DISTINCT path, name, sl, sc, el, ec, arity, var_args FROM roots) r ON e.callee = r.name AND CASE WHEN r.var_args THEN e.args >= r.arity ELSE e.args = r.arity END
    WHERE NOT EXISTS (SELECT 1 FROM roots v WHERE v.path = e.path AND v.name = e.caller AND v.sl = e.sl AND v.sc = e.sc AND v.el = e.el AND v.ec = e.ec))
SELECT DISTINCT path, name, sl, 0 AS depth, cast(NULL AS string) AS parent_path FROM roots
UNION ALL SELECT path, name, sl, 1 AS depth, parent_path FROM callers WHERE first_ = struct_pack(a := parent_path, b := parent_sl, c := psc)""")
def callgraph_depth1(t):
    e = t("elements")
    roots = e.where("element_type in ('FUNCTION', 'METHOD') and name = 's5'").withColumn("params", F.col("arity"))
    found = callgraph.reverse_call_graph(callgraph.call_edges(e), t("imports"), roots, max_layer=1)
    return found.select("path", "name", "sl", "depth", "parent_path")


@query(""" WITH RECURSIVE up(root, name, depth) AS (SELECT 'n7', 'n7', 0 UNION SELECT u.root, e.caller, u.depth + 1 FROM up u JOIN edges e ON e.callee = u.name WHERE u.depth < 3)
SELECT root, name, min(depth) AS depth FROM up GROUP BY root, name""")
def callgraph_bfs(t):
    edges = t("edges")
    return callgraph.reachable_callers(edges, edges.sparkSession.createDataFrame([("n7",)], "name string"), max_layer=3)


# diffs


@query(""" SELECT coalesce(l.path, r.path) AS path, CASE WHEN r.path IS NULL THEN 'add' WHEN l.path IS NULL THEN 'delete' ELSE 'modify' END AS status, coalesce(l.hash, '') AS hash
FROM local_tree l FULL OUTER JOIN remote_tree r ON l.path = r.path WHERE l.hash IS DISTINCT FROM r.hash""")
def hash_tree_diff(t):
    return diffs.tree_diff(t("local_tree"), t("remote_tree"))


@query(""" SELECT l.path, CASE WHEN r.path IS NULL THEN 'add' ELSE 'modify' END AS status, l.hash FROM local_tree l LEFT JOIN remote_tree r ON l.path = r.path WHERE l.hash IS DISTINCT FROM r.hash""")
def hash_tree_diff_nodelete(t):
    return diffs.tree_diff(t("local_tree"), t("remote_tree"), deletes=False)


@query(" SELECT coalesce(l.path, r.path) AS path, coalesce(r.hash, l.hash) AS hash FROM local_tree l FULL OUTER JOIN remote_tree r ON l.path = r.path")
def hash_tree_overlay(t):
    return diffs.overlay(t("local_tree"), t("remote_tree"))


# events

_LATEST = "latest_ AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY workspace, path ORDER BY created_at DESC, id DESC) AS rn FROM queue) z WHERE rn = 1)"


@query(f" WITH {_LATEST} SELECT workspace, path, id, event_type FROM latest_")
def latest_event_per_path(t):
    return events.latest(t("queue")).select("workspace", "path", "id", "event_type")


@query(f""" WITH {_LATEST}, typed AS (SELECT workspace, path, CASE status WHEN 'add' THEN 'add_file' WHEN 'delete' THEN 'delete_file' ELSE 'modify_file' END AS event_type FROM changes)
SELECT c.workspace, c.path, c.event_type, CASE WHEN l.id IS NULL THEN 'create' WHEN (l.embedding_status IN (2, 3) OR l.codegraph_status = 2) THEN CASE WHEN l.event_type = c.event_type THEN 'skip' ELSE 'create' END ELSE 'update' END AS action, l.id
FROM typed c LEFT JOIN latest_ l ON l.workspace = c.workspace AND l.path = c.path""")
def scan_event_plan(t):
    return events.scan_plan(t("changes"), t("queue"))


@query(f""" WITH {_LATEST}, once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY workspace, path ORDER BY created_at DESC, id DESC) AS rn FROM published) z WHERE rn = 1)
SELECT o.workspace, o.path, o.event_type, CASE WHEN l.id IS NULL THEN 'create' ELSE 'update' END AS action, l.id
FROM once o LEFT JOIN (SELECT * FROM latest_ WHERE NOT (embedding_status IN (2, 3) OR codegraph_status = 2)) l ON l.workspace = o.workspace AND l.path = o.path""")
def event_upsert_plan(t):
    return events.upsert_plan(t("published"), t("queue"))


@query(""" SELECT id, event_type, priority, rn FROM (SELECT id, event_type, CASE event_type WHEN 'rebuild_workspace' THEN 1 WHEN 'open_workspace' THEN 2 WHEN 'add_file' THEN 3 WHEN 'modify_file' THEN 4 WHEN 'delete_file' THEN 5 ELSE 6 END AS priority,
  cast(row_number() OVER (PARTITION BY event_type ORDER BY created_at, id) AS int) AS rn FROM queue WHERE codegraph_status = 1) z WHERE rn <= 10""")
def drain_priority(t):
    return events.drained(t("queue"))


_NOW = "TIMESTAMP '2024-01-15 00:00:00'"


def _now():
    return F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")


@query(f""" WITH aged AS (SELECT *, epoch({_NOW}) - epoch(date_trunc('second', updated_at)) AS age FROM queue)
SELECT id, 'codegraph' AS part, 3 AS status FROM aged WHERE codegraph_status = 2 AND age >= 1800
UNION ALL SELECT id, 'embedding', 5 FROM aged WHERE embedding_status = 3 AND age > 180
UNION ALL SELECT id, 'embedding', 4 FROM aged WHERE embedding_status = 2 AND age >= 180""")
def stuck_events(t):
    return events.timed_out(t("queue"), _now())


@query(f" SELECT id, updated_at FROM queue WHERE updated_at < {_NOW} - INTERVAL 48 HOUR")
def expired_events(t):
    return events.expired(t("queue"), _now())


@query(" SELECT id FROM queue WHERE embedding_status IN (1, 4, 5, 6) AND codegraph_status IN (1, 3, 4)")
def nonprocessing_events(t):
    return events.not_processing(t("queue")).select("id")


@query(""" SELECT workspace, id, cast((row_number() OVER (PARTITION BY workspace ORDER BY created_at, id) - 1) // 10 AS bigint) AS batch FROM queue WHERE embedding_status IN (1, 4, 5) AND event_type IN ('add_file', 'modify_file')
UNION ALL SELECT workspace, id, -1 FROM queue WHERE embedding_status IN (1, 4, 5) AND event_type IN ('rename_file', 'delete_file')""")
def upload_batches(t):
    return events.upload_batches(t("queue"))


@query(""" SELECT q.id, CASE WHEN r.status IN ('completed', 'unsupported') THEN 6 WHEN r.status = 'failed' THEN 5 ELSE 3 END AS embedding_status
FROM queue q LEFT JOIN remote_status r ON r.workspace = q.workspace AND r.sync_id = q.sync_id AND r.path = CASE WHEN q.event_type = 'rename_file' THEN q.target ELSE q.path END WHERE q.embedding_status = 3""")
def remote_status_fold(t):
    return events.remote_fold(t("queue"), t("remote_status"))


@query(""" SELECT q.id, coalesce(nullif(u.sync_id, ''), q.sync_id) AS sync_id, coalesce(nullif(u.embedding_status, 0), q.embedding_status) AS embedding_status, CASE WHEN u.id IS NULL THEN q.updated_at ELSE TIMESTAMP '2024-01-15 00:00:00' END AS updated_at FROM queue q LEFT JOIN event_updates u ON u.id = q.id""")
def event_merge(t):
    return events.merged(t("queue"), t("event_updates"), _now()).select("id", "sync_id", "embedding_status", "updated_at")


@query(""" SELECT q.id, CASE WHEN q.id % 6 = 0 THEN 3 WHEN q.id % 2 = 0 THEN 4 ELSE q.codegraph_status END AS codegraph_status FROM queue q""")
def event_finalise(t):
    done = t("queue").where("id % 2 = 0").select("id", (F.col("id") % 3 != 0).alias("ok"))
    return events.finished(t("queue"), done).select("id", "codegraph_status")


@query(" SELECT id, workspace, created_at FROM queue ORDER BY created_at DESC, id LIMIT 50 OFFSET 20")
def event_page(t):
    return events.page(t("queue"), 50, 20).select("id", "workspace", "created_at")


@query(" SELECT sync_id, count(*) AS n FROM queue WHERE sync_id <> '' GROUP BY sync_id")
def events_by_sync(t):
    return t("queue").where("sync_id <> ''").groupBy("sync_id").agg(F.count(F.lit(1)).alias("n"))


# status


@query(""" WITH e AS (SELECT workspace, count(*) FILTER (codegraph_status IN (1, 2)) AS busy, count(*) FILTER (codegraph_status = 3) AS bad FROM queue GROUP BY workspace),
  p AS (SELECT w.*, e.busy, e.bad, CASE WHEN file_num <= 0 OR done <= 0 THEN 0.0 ELSE least(round(done::DOUBLE / file_num * 100, 1), 100.0) END AS process FROM workspaces w LEFT JOIN e ON e.workspace = w.workspace)
SELECT workspace, process::DOUBLE AS process, CASE WHEN file_num <= 0 THEN 'pending' WHEN process >= 100 THEN 'success' WHEN coalesce(busy, 0) > 0 THEN 'running' WHEN coalesce(bad, 0) > 0 AND process < 90 THEN 'failed' ELSE 'success' END AS status FROM p""")
def status_progress(t):
    return status.status(t("workspaces"), t("queue"))


@query(" SELECT count(*) AS n FROM queue WHERE workspace IN ('/ws1', '/ws2', '/ws3') AND embedding_status IN (1, 2, 3)")
def counts_by_status(t):
    return status.counts_by_status(t("queue"), ["/ws1", "/ws2", "/ws3"], [1, 2, 3])


@query(" SELECT count(*) AS n FROM queue WHERE event_type IN ('add_file', 'rename_file')")
def counts_by_type(t):
    return status.counts_by_type(t("queue"), ["add_file", "rename_file"])


@query(" SELECT workspace, bool_and(embedding_status = 6 AND codegraph_status = 4) AS done FROM queue GROUP BY workspace")
def all_success(t):
    return status.all_succeeded(t("queue"))


@query(""" SELECT workspace, string_agg(path, ',' ORDER BY path) AS paths, min_by(message, path) AS message FROM (SELECT *, row_number() OVER (PARTITION BY workspace ORDER BY path) AS rn
  FROM (SELECT workspace, path, min(concat(sync_id, ' failed')) AS message FROM queue WHERE embedding_status IN (4, 5) GROUP BY workspace, path) a) b WHERE rn <= 5 GROUP BY workspace""")
def failed_digest(t):
    return status.failed_digest(t("queue").where("embedding_status in (4, 5)").withColumn("message", F.concat("sync_id", F.lit(" failed"))))


@query(f""" WITH aged AS (SELECT workspace, active, file_num, {_NOW} - to_hours(cast(file_num * 2 AS int)) AS updated_at FROM workspaces)
SELECT workspace, 'on' AS mode FROM aged WHERE active = 'false' AND file_num > 0 AND updated_at <= {_NOW} - INTERVAL 72 HOUR
UNION ALL SELECT workspace, 'off' FROM aged WHERE active = 'false' AND file_num > 0 AND updated_at <= {_NOW} - INTERVAL 24 HOUR""")
def expired_indexes(t):
    aged = t("workspaces").withColumn("updated_at", _now() - F.make_dt_interval(F.lit(0), (F.col("file_num") * 2).cast("int")))
    return status.expired_indexes(aged, _now()).withColumn("mode", F.lit("on")).unionByName(status.expired_indexes(aged, _now(), enabled=False).withColumn("mode", F.lit("off")))


@query(" SELECT count(*) AS total_files, cast(sum(n) AS bigint) AS total_symbols, cast(sum(v) AS bigint) AS total_variables, count(*) FILTER (v > 3) AS failed_files FROM (SELECT path, count(*) AS n, count(*) FILTER (element_type = 'VARIABLE') AS v FROM elements GROUP BY path) z")
def index_metrics(t):
    files = t("elements").groupBy("path").agg(F.count(F.lit(1)).alias("symbols"), F.count_if(F.col("element_type") == "VARIABLE").alias("variables"))
    return status.index_metrics(files.withColumn("failed", F.col("variables") > 3))


# index changes


@query(" SELECT path, ordinal FROM elements WHERE NOT (path = '/ws/p8' OR starts_with(path, '/ws/p8/') OR starts_with(path, '/ws/p16/pkg0/'))")
def index_remove(t):
    return index.remove_paths(t("elements"), ["/ws/p8", "/ws/p16/pkg0/"]).select("path", "ordinal")


@query(" SELECT CASE WHEN starts_with(path, '/ws/p8/') THEN concat('/ws/moved', substring(path, 7)) ELSE path END AS path, ordinal, language FROM elements")
def index_rename(t):
    return index.rename_paths(t("elements"), "/ws/p8", "/ws/moved").select("path", "ordinal", "language")


@query(""" SELECT path, ordinal, name FROM elements WHERE path NOT IN (SELECT path FROM elements WHERE ordinal = 20)
UNION ALL SELECT path, ordinal, concat(name, '_new') FROM elements WHERE path IN (SELECT path FROM elements WHERE ordinal = 20)""")
def index_merge(t):
    e = t("elements").select("path", "ordinal", "name")
    again = e.join(e.where("ordinal = 20").select("path").distinct(), "path", "left_semi").withColumn("name", F.concat("name", F.lit("_new")))
    return index.reindexed(e, again)


@query(""" SELECT l.path, l.hash FROM local_tree l WHERE l.path NOT IN (SELECT path FROM remote_tree) UNION ALL SELECT path, hash FROM remote_tree""")
def table_upsert(t):
    return index.upsert(t("local_tree"), t("remote_tree"), "path")


@query(""" SELECT p.project, count(e.path) AS total_files, CASE WHEN count(e.path) > 0 THEN 'success' ELSE 'pending' END AS status
FROM projects p LEFT JOIN (SELECT DISTINCT path FROM elements) e ON starts_with(e.path, concat(p.root, '/')) GROUP BY p.project""")
def index_summary(t):
    files = mutations.of_projects(t("elements"), t("projects")).join(t("projects"), "root").select("project", "path")
    return index.index_summary(files, t("projects").select("project"))


@query(""" SELECT concat('{"language":"', language, '","name":"', name, '","occurrences":[', string_agg(concat('{"path":"', path, '","sl":', sl, ',"sc":', sc, ',"el":', el, ',"ec":', ec, ',"element_type":"', element_type, '"}'), ',' ORDER BY path, sl, sc, el, ec, element_type), ']}') AS value FROM symbols GROUP BY language, name""")
def export_ndjson(t):
    return index.export_rows(index.symbol_table(t("elements")))


# extraction


@query()
def extract_elements(t):
    return extract.extract_elements(samples.sources(t("elements")))


_HEAD = "CASE language WHEN 'java' THEN 3 ELSE 2 END"
_MADE = f"made AS (SELECT path, language, name, arity, {_HEAD} + ordinal - 1 AS sl, CASE WHEN element_type IN ('FUNCTION', 'METHOD') THEN CASE language WHEN 'java' THEN 'METHOD' ELSE 'FUNCTION' END WHEN element_type = 'CALL' THEN 'CALL' ELSE 'VARIABLE' END AS kind FROM elements)"


@query(f" WITH {_MADE} SELECT path, name, kind AS element_type, cast(sl AS int) AS sl, CASE WHEN kind <> 'VARIABLE' THEN arity END AS arity FROM made")
def extract_known(t):
    """What is read from the made-up sources is what they were made of: each element's kind, line and arity."""
    found = extract.extract_elements(samples.sources(t("elements")))
    return found.where(F.col("name").rlike("^s[0-9]+$")).select("path", "name", "element_type", "sl", "arity")


@query(f""" WITH {_MADE} SELECT path, CASE WHEN kind = 'VARIABLE' THEN CASE language WHEN 'java' THEN 'declaration.field' WHEN 'typescript' THEN 'declaration.variable' WHEN 'go' THEN 'global_variable' WHEN 'javascript' THEN 'global_variable' ELSE 'variable' END
  WHEN language = 'java' THEN 'declaration.method' WHEN language IN ('python', 'cpp') THEN 'definition.function' ELSE 'declaration.function' END AS type, name, cast(sl + 1 AS int) AS start_line, cast(sl + 1 AS int) AS end_line FROM made WHERE kind <> 'CALL'""")
def structure_known(t):
    return extract.file_structure(samples.sources(t("elements"))).where(F.col("name").rlike("^s[0-9]+$"))


@query()
def file_structure(t):
    return extract.file_structure(samples.sources(t("elements")))


from . import programs  # noqa: E402, F401  (registers its queries)
