"""The change-event queue in batch form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import CODEGRAPH, DRAIN_ORDER, EMBEDDING

#: Event types of file states.
EVENT_OF = {"add": "add_file", "modify": "modify_file", "delete": "delete_file"}


def latest(events: DataFrame) -> DataFrame:
    """The latest event of each workspace and path; ties go to the greater id.  Combined before the shuffle."""
    columns = [c for c in events.columns if c not in ("workspace", "path")]
    best = F.max_by(F.struct(*columns), F.struct("created_at", "id"))
    return events.groupBy("workspace", "path").agg(best.alias("e")).select("workspace", "path", *[F.col("e")[c].alias(c) for c in columns])


def in_progress() -> Column:
    return F.col("embedding_status").isin(2, 3) | (F.col("codegraph_status") == 2)


def typed(changes: DataFrame) -> DataFrame:
    """(workspace, path, event_type) of changes (workspace, path, status): the plain events that a scan makes where no known ones are looked up."""
    status = F.col("status")
    return changes.select("workspace", "path", F.when(status == "add", EVENT_OF["add"]).when(status == "delete", EVENT_OF["delete"]).otherwise(EVENT_OF["modify"]).alias("event_type"))


def scan_plan(changes: DataFrame, events: DataFrame) -> DataFrame:
    """(workspace, path, event_type, action, id): what a file scan does for each change.

    changes: workspace, path, status.  An event that is in progress with the same type is left
    alone (skip), with another type a new one is made (create); any other is overwritten (update).
    """
    wanted = typed(changes).withColumnRenamed("event_type", "new_type")
    known = latest(events).select("workspace", "path", "id", "event_type", in_progress().alias("busy"))
    found = wanted.join(known, ["workspace", "path"], "left")
    action = F.when(F.col("id").isNull(), "create").when(F.col("busy") & (F.col("event_type") == F.col("new_type")), "skip").when(F.col("busy"), "create").otherwise("update")
    return found.select("workspace", "path", F.col("new_type").alias("event_type"), action.alias("action"), "id")


def upsert_plan(new: DataFrame, events: DataFrame) -> DataFrame:
    """(workspace, path, event_type, action, id) for published events: a latest one that isn't in progress is overwritten."""
    known = latest(events).where(~in_progress()).select("workspace", "path", "id")
    once = new.groupBy("workspace", "path").agg(F.max_by("event_type", F.struct("created_at", F.col("id"))).alias("event_type"))
    return once.join(known, ["workspace", "path"], "left").select("workspace", "path", "event_type", F.when(F.col("id").isNull(), "create").otherwise("update").alias("action"), "id")


def drained(events: DataFrame, per_type: int | None = 10) -> DataFrame:
    """The open events of one poll: types in their fixed order, the oldest ``per_type`` of each (None: all)."""
    order = F.array(*map(F.lit, DRAIN_ORDER))
    ready = events.where(F.col("codegraph_status").isin(1)).withColumn("priority", F.array_position(order, F.col("event_type"))).where("priority > 0")
    w = Window.partitionBy("priority").orderBy("created_at", "id")
    numbered = ready.withColumn("rn", F.row_number().over(w))
    return (numbered if per_type is None else numbered.where(F.col("rn") <= per_type)).select("id", "event_type", F.col("priority").cast("int").alias("priority"), "rn")


def polls(events: DataFrame, per_type: int = 10) -> DataFrame:
    """All open events with the poll (from 0) that takes each, if none comes in between: as of ``drained``, again and again."""
    return drained(events, None).withColumn("poll", F.floor((F.col("rn") - 1) / per_type).cast("int"))


def timed_out(events: DataFrame, now: Column) -> DataFrame:
    """(id, part, failed status) of events that stay too long in a state."""
    age = F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.col("updated_at").cast("timestamp"))
    rows = events.withColumn("age", age)
    graph = rows.where("codegraph_status = 2 and age >= 1800").select("id", F.lit("codegraph").alias("part"), F.lit(3).alias("status"))
    build = rows.where("embedding_status = 3 and age > 180").select("id", F.lit("embedding").alias("part"), F.lit(5).alias("status"))
    upload = rows.where("embedding_status = 2 and age >= 180").select("id", F.lit("embedding").alias("part"), F.lit(4).alias("status"))
    return graph.unionByName(build).unionByName(upload)


def expired(events: DataFrame, now: Column, hours: int = 48) -> DataFrame:
    """Ids of events last changed strictly before ``hours`` ago, the oldest first."""
    return events.where(F.col("updated_at") < now - F.expr(f"interval {hours} hours")).select("id", "updated_at").orderBy("updated_at", "id")


def not_processing(events: DataFrame) -> DataFrame:
    """Events that a reset deletes: neither side is at work."""
    return events.where(F.col("embedding_status").isin(1, 4, 5, 6) & F.col("codegraph_status").isin(1, 3, 4))


def inserted(events: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """events and the rows of new, numbered on from the greatest id in order of path; both times are ``now``.

    As in the queue itself, sync_id and file_hash of a new row aren't stored.  Only the greatest id
    and the rows of each workspace are counted on the driver, not the rows.
    """
    top = events.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    counts = {r["workspace"]: r["count"] for r in new.groupBy("workspace").count().orderBy("workspace").collect()}
    first, at = [], top
    for workspace, n in counts.items():
        first.append((workspace, at))
        at += n
    begins = new.sparkSession.createDataFrame(first, "workspace string, begin long")
    w = Window.partitionBy("workspace").orderBy("path", "event_type")
    numbered = new.drop("id").withColumn("at", F.row_number().over(w)).join(F.broadcast(begins), new["workspace"].eqNullSafe(begins["workspace"])).drop(begins["workspace"])
    stored = {"id": F.col("begin") + F.col("at"), "created_at": now, "updated_at": now, "sync_id": F.lit(""), "file_hash": F.lit("")}
    rows = numbered.withColumns({c: x for c, x in stored.items() if c in events.columns})
    return events.unionByName(rows.drop("begin", "at"), allowMissingColumns=True).select(events.columns)


def page(events: DataFrame, limit: int, offset: int = 0, *, newest_first: bool = True) -> DataFrame:
    """Events by time of creation, ties by id: ``limit`` of them after the first ``offset``."""
    time = F.desc("created_at") if newest_first else F.asc("created_at")
    return events.orderBy(time, "id").offset(offset).limit(limit)


def with_status_names(events: DataFrame) -> DataFrame:
    """events with the names of both states (embedding, codegraph); a number without a name gives null."""
    named = lambda names, c: F.try_element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), F.col(c))
    return events.withColumns({"embedding": named(EMBEDDING, "embedding_status"), "codegraph": named(CODEGRAPH, "codegraph_status")})


def deleted(events: DataFrame, ids: DataFrame) -> DataFrame:
    """events without the listed ids."""
    return events.join(ids.select("id").distinct(), "id", "left_anti").select(events.columns)


def published(events: DataFrame, ignored: Column) -> DataFrame:
    """The events that reach the queue: those whose file isn't ignored.

    ``ignored`` is a condition on a column ``file``, which is the target of a rename and the path
    of others; deletions always pass.
    """
    file = F.when(F.col("event_type") == "rename_file", F.col("target")).otherwise(F.col("path"))
    rows = events.withColumn("file", file)
    return rows.where((F.col("event_type") == "delete_file") | ~F.coalesce(ignored, F.lit(False))).drop("file")


def retained(events: DataFrame, now: Column, hours: int = 48) -> DataFrame:
    """What a clean-up leaves: nothing if every event succeeded on both sides, else the events of the last ``hours``."""
    open_ = events.where(~((F.col("embedding_status") == 6) & (F.col("codegraph_status") == 4))).select(F.lit(True).alias("open")).limit(1)
    young = events.where(~(F.col("updated_at") < now - F.expr(f"interval {hours} hours")))
    return young.join(open_, F.lit(True), "left_semi")  # one row or none on the right


def synced(tree: DataFrame, uploaded: DataFrame, finished: DataFrame) -> DataFrame:
    """(workspace, path, hash, state) of the files of a workspace after uploads and their outcomes.

    tree: the hash tree (workspace, path, hash); uploaded: files that were sent (workspace, path,
    hash); finished: answers for sent files (workspace, path, ok).  A file that was sent waits
    (sync) until it is answered; then its hash enters the tree (done) or it is listed as failed,
    with the tree's old hash.  Other files of the tree are done.
    """
    keys = ["workspace", "path"]
    sent = uploaded.select(*keys, F.col("hash").alias("sent")).join(finished.select(*keys, "ok"), keys, "left")
    both = tree.select(*keys, "hash").join(sent, keys, "full_outer")
    state = F.when(F.col("sent").isNull() | F.col("ok"), "done").when(F.col("ok").isNull(), "sync").otherwise("failed")
    return both.select(*keys, F.when(F.col("ok"), F.col("sent")).otherwise(F.col("hash")).alias("hash"), state.alias("state"))


def finished(events: DataFrame, done: DataFrame) -> DataFrame:
    """Events with the outcomes in done (id, ok) written to codegraph_status."""
    joined = events.join(done, "id", "left")
    status = F.when(F.col("ok"), 4).when(~F.col("ok"), 3).otherwise(F.col("codegraph_status"))
    return joined.withColumn("codegraph_status", status).select(events.columns)


def merged(events: DataFrame, updates: DataFrame, now: Column | None = None) -> DataFrame:
    """events with the set fields of updates (by id); empty texts and zeros are not set.

    updated_at of every event that updates name is ``now``, by default the current time.
    """
    fields = [c for c in updates.columns if c != "id"]
    joined = events.join(updates.select("id", F.lit(True).alias("updated"), *[F.col(c).alias(f"new_{c}") for c in fields]), "id", "left")
    kinds = dict(events.dtypes)
    unset = lambda c: F.nullif(F.col(f"new_{c}"), F.lit("" if kinds[c] == "string" else 0))
    stamp = F.current_timestamp() if now is None else now
    stamped = lambda c: F.when(F.col("updated"), stamp.cast(events.schema[c].dataType)).otherwise(F.col(c))
    return joined.select(*[(stamped(c) if c == "updated_at" else F.coalesce(unset(c), F.col(c)) if c in fields else F.col(c)).alias(c) for c in events.columns])


def remote_fold(events: DataFrame, remote: DataFrame) -> DataFrame:
    """(id, embedding_status): building events after the answers for their uploads and paths (target of a rename).

    remote: workspace, sync_id, path, status; an answer counts for the events of its upload alone.
    completed or unsupported is success, failed is a failed build, anything else changes nothing.
    """
    path = F.when(F.col("event_type") == "rename_file", F.col("target")).otherwise(F.col("path"))
    waiting = events.where("embedding_status = 3").select("id", "workspace", "sync_id", path.alias("wanted"))
    answer = remote.select(F.col("path").alias("wanted"), "workspace", "sync_id", "status").dropDuplicates(["workspace", "sync_id", "wanted"])
    found = waiting.join(answer, ["workspace", "sync_id", "wanted"], "left")
    status = F.when(F.col("status").isin("completed", "unsupported"), 6).when(F.col("status") == "failed", 5).otherwise(3)
    return found.select("id", status.alias("embedding_status"))


def upload_batches(events: DataFrame, size: int = 10) -> DataFrame:
    """(workspace, id, batch): add and modify events in batches by age; renames and deletes are batch -1."""
    open_ = events.where(F.col("embedding_status").isin(1, 4, 5))
    w = Window.partitionBy("workspace").orderBy("created_at", "id")
    files = open_.where(F.col("event_type").isin("add_file", "modify_file")).select("workspace", "id", F.floor((F.row_number().over(w) - 1) / size).cast("long").alias("batch"))
    rest = open_.where(F.col("event_type").isin("rename_file", "delete_file")).select("workspace", "id", F.lit(-1).cast("long").alias("batch"))
    return files.unionByName(rest)
