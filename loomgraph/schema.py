"""Tables of the code index and the event queue."""

from __future__ import annotations

from pyspark.sql import types as T

PARAM = T.StructType([T.StructField("name", T.StringType()), T.StructField("type", T.ArrayType(T.StringType()))])


def _table(spec: str) -> T.StructType:
    return T._parse_datatype_string(spec)


#: One row for each file.
FILES = "project string, path string, language string, ts bigint, package string"
IMPORTS = "path string, ordinal int, name string, source string, alias string, sl int, sc int, el int, ec int"
ELEMENTS = "path string, language string, ordinal int, name string, element_type string, is_definition boolean, sl int, sc int, el int, ec int, params array<struct<name:string,type:array<string>>>, return_type array<string>, super_classes array<string>, scope string, owner string"
EVENTS = "id bigint, workspace string, event_type string, path string, target string, sync_id string, file_hash string, embedding_status int, codegraph_status int, created_at timestamp_ntz, updated_at timestamp_ntz"
HASH_TREE = "codebase_id string, path string, hash string"

#: States of an event.
EMBEDDING = {1: "init", 2: "uploading", 3: "building", 4: "uploadFailed", 5: "buildFailed", 6: "success"}
CODEGRAPH = {1: "init", 2: "building", 3: "failed", 4: "success"}
#: Event types in the order in which they are drained.
DRAIN_ORDER = ("rebuild_workspace", "open_workspace", "add_file", "modify_file", "delete_file", "rename_file")
