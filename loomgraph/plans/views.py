"""Model tables made of the driver's tables, as text that Spark SQL and DuckDB read alike.

``SELECTS`` has one select for each table.  ``table`` gives it as a DataFrame; ``with_views``
prefixes a DuckDB query with those that it names.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_EXT = "CASE {f} % 48 WHEN 0 THEN '.go' WHEN 8 THEN '.java' WHEN 16 THEN '.py' WHEN 24 THEN '.js' WHEN 32 THEN '.ts' ELSE '.cpp' END"
_LANG = "CASE {f} % 48 WHEN 0 THEN 'go' WHEN 8 THEN 'java' WHEN 16 THEN 'python' WHEN 24 THEN 'javascript' WHEN 32 THEN 'typescript' ELSE 'cpp' END"
_PATH = "concat('/ws/p', cast({f} % 24 AS string), '/pkg', cast({f} % 40 AS string), '/d', cast({f} AS string), " + _EXT + ")"
_LINE = "l_orderkey - l_orderkey % 8"
_ORDER = "o_orderkey - o_orderkey % 8"

SELECTS = {
    "files": """
        SELECT doc_id, concat('/ws/', source, '/', lang, '/', CASE WHEN doc_id % 11 = 0 THEN '.cache/' ELSE '' END, 'd', cast(doc_id AS string),
            CASE doc_id % 6 WHEN 0 THEN '.go' WHEN 1 THEN '.java' WHEN 2 THEN '.py' WHEN 3 THEN '.tsx' WHEN 4 THEN '.h' ELSE '' END) AS path,
            text AS content, n_chars AS size, doc_id * 10 AS ts, doc_id % 9 AS first_line, doc_id % 9 + doc_id % 4 AS last_line
        FROM documents""",
    "old_index": "SELECT path, CASE WHEN doc_id % 5 = 0 THEN ts - 1 ELSE ts END AS ts FROM files WHERE doc_id % 7 <> 0",
    "elements": f"""
        SELECT {_PATH.format(f="f")} AS path, {_LANG.format(f="f")} AS language, cast(row_number() OVER (PARTITION BY f ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS int) AS ordinal,
            concat('s', cast(l_partkey AS string)) AS name,
            CASE l_linenumber WHEN 1 THEN 'FUNCTION' WHEN 2 THEN 'METHOD' WHEN 5 THEN 'REFERENCE' WHEN 7 THEN 'VARIABLE' ELSE 'CALL' END AS element_type,
            l_linenumber IN (1, 2, 7) AS is_definition,
            cast((l_linenumber - 1) * 10 + l_suppkey % 10 AS int) AS sl, cast(l_suppkey % 40 AS int) AS sc,
            cast((l_linenumber - 1) * 10 + l_suppkey % 10 + CASE WHEN l_linenumber < 3 THEN 25 + l_partkey % 30 * 8 ELSE 0 END AS int) AS el, cast(l_suppkey % 40 + 5 AS int) AS ec,
            cast(CASE WHEN l_linenumber < 3 THEN l_partkey % 3 ELSE (l_partkey + l_suppkey % 2) % 3 END AS int) AS arity, l_suppkey % 7 = 0 AS var_args
        FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, {_LINE} AS f FROM lineitem)""",
    "imports": f"""
        SELECT DISTINCT {_PATH.format(f="(" + _ORDER + ")")} AS path, concat('pkg', cast(o_custkey * 8 % 40 AS string), '.d', cast(o_custkey % 90 AS string)) AS name,
            CASE o_custkey % 4 WHEN 0 THEN 'zz' ELSE concat('p', cast(o_custkey * 8 % 24 AS string), '.pkg', cast(o_custkey * 8 % 40 AS string)) END AS source
        FROM orders""",
    "symbols": "SELECT language, name, path, sl, sc, el, ec, element_type FROM elements WHERE element_type IN ('CLASS', 'INTERFACE', 'METHOD', 'FUNCTION', 'VARIABLE')",
    "raw_imports": """
        SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'go' WHEN 1 THEN 'java' WHEN 2 THEN 'python' WHEN 3 THEN 'javascript' WHEN 4 THEN 'cpp' WHEN 5 THEN 'c' ELSE 'typescript' END AS language,
            CASE p_size % 12 WHEN 0 THEN 'fmt' WHEN 1 THEN 'java.util.List' WHEN 2 THEN 'os.path' WHEN 3 THEN 'fs' WHEN 4 THEN '<vector>' WHEN 5 THEN 'stdio.h' WHEN 6 THEN 'acme/lib/x'
                WHEN 7 THEN './util' WHEN 8 THEN 'com.acme.Thing' WHEN 9 THEN 'acme.core.y' WHEN 10 THEN 'encoding/json' ELSE '../a/b*' END AS name,
            CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN './util/x' WHEN 2 THEN '../lib/y' WHEN 3 THEN 'acme/lib/x' ELSE 'com\\acme' END AS source,
            concat('/ws/p/src/m', cast(p_partkey % 50 AS string), '/f.go') AS file
        FROM part""",
    "edges": "SELECT DISTINCT concat('n', cast(l_partkey % 100 AS string)) AS callee, concat('n', cast(l_suppkey AS string)) AS caller FROM lineitem",
    "local_tree": "SELECT c_name AS path, cast(c_custkey AS string) AS hash FROM customer WHERE c_custkey % 11 <> 0",
    "remote_tree": "SELECT c_name AS path, CASE WHEN c_custkey % 5 = 0 THEN concat('x', cast(c_custkey AS string)) ELSE cast(c_custkey AS string) END AS hash FROM customer WHERE c_custkey % 7 <> 0",
    "queue": """
        SELECT event_id AS id, concat('/ws', cast(user_id AS string)) AS workspace,
            CASE event_type WHEN 'click' THEN 'add_file' WHEN 'error' THEN 'delete_file' WHEN 'purchase' THEN 'modify_file' WHEN 'signup' THEN 'open_workspace' ELSE 'rename_file' END AS event_type,
            concat('/f', regexp_extract(props, '[0-9]+', 0)) AS path, concat('/t', regexp_extract(props, '[0-9]+', 0)) AS target,
            concat('sync', cast(event_id % 40 AS string)) AS sync_id, cast(event_id % 6 + 1 AS int) AS embedding_status, cast(event_id % 4 + 1 AS int) AS codegraph_status, ts AS created_at, ts AS updated_at
        FROM events""",
    "published": "SELECT id, workspace, CASE id % 3 WHEN 0 THEN event_type WHEN 1 THEN 'modify_file' ELSE 'delete_file' END AS event_type, path, created_at FROM queue",
    "changes": """
        SELECT DISTINCT concat('/ws', cast(user_id AS string)) AS workspace, concat('/f', cast(user_id % 100 + k AS string)) AS path,
            CASE (user_id + k) % 3 WHEN 0 THEN 'add' WHEN 1 THEN 'modify' ELSE 'delete' END AS status
        FROM events CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 7 UNION ALL SELECT 31) few""",
    "remote_status": """
        SELECT DISTINCT workspace, sync_id, path, CASE (length(path) + length(workspace) + length(sync_id)) % 4 WHEN 0 THEN 'completed' WHEN 1 THEN 'failed' WHEN 2 THEN 'processing' ELSE 'unsupported' END AS status
        FROM (SELECT workspace, sync_id, path FROM queue UNION ALL SELECT workspace, sync_id, target AS path FROM queue WHERE id % 2 = 0) both_""",
    "source_texts": "SELECT DISTINCT path, repeat(concat('  line of ', path, ' ', chr(10), chr(10)), 20) AS content FROM elements",
    "event_updates": "SELECT id, CASE WHEN id % 2 = 0 THEN '' ELSE 'changed' END AS sync_id, cast(id % 5 AS int) AS embedding_status FROM queue WHERE id % 10 < 4",
    "workspaces": """
        SELECT concat('/ws', cast(c_custkey AS string)) AS workspace, CASE WHEN c_nationkey % 2 = 0 THEN 'true' ELSE 'false' END AS active,
            c_custkey % 90 AS file_num, c_custkey % 90 * (c_custkey % 13) // 12 AS done
        FROM customer""",
    "projects": "SELECT concat('p', cast(k AS string)) AS project, concat('/ws/p', cast(k AS string)) AS root FROM (SELECT 0 AS k UNION ALL SELECT 8 UNION ALL SELECT 16 UNION ALL SELECT 99) few",
}
_NEEDS = {name: [n for n in SELECTS if n != name and re.search(rf"\b(FROM|JOIN) {n}\b", text)] for name, text in SELECTS.items()}
_TABLES = ("documents", "lineitem", "orders", "part", "customer", "events")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The model table as a lazy DataFrame over the Parquet files."""
    text = SELECTS[name].replace("//", "DIV").replace("\\", "\\\\")
    sources = {}
    for n in _NEEDS[name]:
        sources[n] = table(spark, sf_dir, n)
    for n in _TABLES:
        if re.search(rf"\b(FROM|JOIN) {n}\b", text):
            sources[n] = spark.read.parquet(f"{sf_dir}/{n}.parquet")
    for n in sources:
        text = re.sub(rf"\b(FROM|JOIN) {n}\b", rf"\1 {{{n}}} AS {n}", text)
    return spark.sql(text, **sources)


def with_views(sql: str) -> str:
    """A DuckDB query with the definitions of the model tables that it reads, in order."""
    order: list[str] = []

    def need(name: str) -> None:
        for n in _NEEDS[name]:
            need(n)
        if name not in order:
            order.append(name)

    for name in SELECTS:
        if re.search(rf"\b(FROM|JOIN|from|join) {name}\b", sql):
            need(name)
    heads = [f"{n} AS MATERIALIZED ({SELECTS[n]})" for n in order]
    found = re.match(r"\s*WITH (RECURSIVE )?", sql)
    if found:
        return f"WITH {found[1] or ''}" + ", ".join([*heads, sql[found.end() :]])
    return ("WITH " + ", ".join(heads) + sql) if heads else sql
