"""The table of workspaces: one row for each, as functions from an old snapshot to a new one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def created(workspaces: DataFrame, new: DataFrame) -> DataFrame:
    """workspaces and the rows of new whose workspace isn't there yet; columns that new lacks are null."""
    fresh = new.dropDuplicates(["workspace"]).join(workspaces.select("workspace"), "workspace", "left_anti")
    return workspaces.unionByName(fresh, allowMissingColumns=True).select(workspaces.columns)


def updated(workspaces: DataFrame, updates: DataFrame, now: Column) -> DataFrame:
    """workspaces with the fields of updates (by workspace) that aren't null; updated_at of these rows is ``now``."""
    fields = [c for c in updates.columns if c != "workspace"]
    new = updates.select("workspace", F.lit(True).alias("new_row"), *[F.col(c).alias(f"new_{c}") for c in fields])
    joined = workspaces.join(new, "workspace", "left")
    out = [(F.coalesce(f"new_{c}", c) if c in fields else F.col(c)).alias(c) for c in workspaces.columns]
    out = [F.when(F.col("new_row"), now).otherwise(F.col(c)).alias(c) if c == "updated_at" else x for c, x in zip(workspaces.columns, out, strict=True)]
    return joined.select(*out)


def deleted(workspaces: DataFrame, names: DataFrame) -> DataFrame:
    """workspaces without those in names."""
    return workspaces.join(names.select("workspace").distinct(), "workspace", "left_anti").select(workspaces.columns)


def active(workspaces: DataFrame) -> DataFrame:
    """Workspaces that are switched on."""
    return workspaces.where(F.col("active") == "true")


def of_active(events: DataFrame, workspaces: DataFrame) -> DataFrame:
    """Events of workspaces that are switched on."""
    return events.join(active(workspaces).select("workspace"), "workspace", "left_semi").select(events.columns)


def listed(workspaces: DataFrame, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Workspaces, those last created first, by pages; ties go by name."""
    ordered = workspaces.orderBy(F.desc("created_at"), "workspace").offset(offset)
    return ordered if limit is None else ordered.limit(limit)


def progressed(workspaces: DataFrame, batches: DataFrame) -> DataFrame:
    """workspaces with ``done`` after further batches (workspace, processed): what was done before and theirs, at most file_num."""
    more = batches.groupBy("workspace").agg(F.sum("processed").alias("more"))
    joined = workspaces.join(more, "workspace", "left")
    done = F.least(F.col("file_num"), F.coalesce("done", F.lit(0)) + F.coalesce("more", F.lit(0)))
    return joined.withColumn("done", done).select(workspaces.columns)


def reset(workspaces: DataFrame, names: DataFrame) -> DataFrame:
    """workspaces with file_num and done at 0 for those in names: their index is gone."""
    joined = workspaces.join(names.select("workspace", F.lit(True).alias("gone")).distinct(), "workspace", "left")
    zero = lambda c: F.when(F.col("gone"), 0).otherwise(F.col(c)).cast(workspaces.schema[c].dataType).alias(c)
    return joined.select(*[zero(c) if c in ("file_num", "done") else F.col(c) for c in workspaces.columns])


def switched(workspaces: DataFrame, events: DataFrame, wanted: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(workspaces, events) after wanted (workspace, active "true" or "false").

    A workspace whose state doesn't change keeps its events.  One that is switched loses its events
    that neither side is working on; switched on, it gets an open_workspace event of time ``now``.
    """
    known = workspaces.select("workspace", F.col("active").alias("was"))
    changed = wanted.select("workspace", "active").dropDuplicates(["workspace"]).join(known, "workspace").where(F.col("active") != F.col("was")).select("workspace", "active")
    idle = F.col("embedding_status").isin(1, 4, 5, 6) & F.col("codegraph_status").isin(1, 3, 4)
    flagged = events.join(changed.select("workspace", F.lit(True).alias("switched")), "workspace", "left")
    kept = flagged.where(~(F.coalesce("switched", F.lit(False)) & idle)).select(events.columns)
    opened = changed.where("active = 'true'").select(
        F.xxhash64("workspace", F.lit("open")).alias("id"), "workspace", F.lit("open_workspace").alias("event_type"), F.lit("").alias("path"),
        F.lit(1).alias("embedding_status"), F.lit(1).alias("codegraph_status"), now.alias("created_at"), now.alias("updated_at"),
    )
    return updated(workspaces, changed, now), kept.unionByName(opened, allowMissingColumns=True).select(events.columns)


def rebuild_events(workspaces: DataFrame, events: DataFrame, now: Column) -> DataFrame:
    """New rebuild_workspace events, one for each workspace that has no open or running one."""
    waiting = events.where((F.col("event_type") == "rebuild_workspace") & F.col("codegraph_status").isin(1, 2)).select("workspace")
    fresh = workspaces.select("workspace").distinct().join(waiting, "workspace", "left_anti")
    return fresh.select("workspace", F.lit("rebuild_workspace").alias("event_type"), F.lit(1).alias("embedding_status"), F.lit(1).alias("codegraph_status"), now.alias("created_at"), now.alias("updated_at"))
