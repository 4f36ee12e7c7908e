"""Counts, progress and status of workspaces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def counts_by_status(events: DataFrame, workspaces: list[str] | None = None, embedding: list[int] | None = None, codegraph: list[int] | None = None) -> DataFrame:
    """One row, n: events that pass the filters that are given."""
    for column, values in (("workspace", workspaces), ("embedding_status", embedding), ("codegraph_status", codegraph)):
        if values:
            events = events.where(F.col(column).isin(*values))
    return events.agg(F.count(F.lit(1)).alias("n"))


def counts_by_type(events: DataFrame, types: list[str]) -> DataFrame:
    """One row, n: events of these types; no types give 0."""
    return events.where(F.col("event_type").isin(*types) if types else F.lit(False)).agg(F.count(F.lit(1)).alias("n"))


def _progress(done: Column, total: Column) -> Column:
    share = F.round(done / total * 100, 1)
    return F.when(total <= 0, 0.0).when(done <= 0, 0.0).otherwise(F.least(share, F.lit(100.0)))


def status(workspaces: DataFrame, events: DataFrame, part: str = "codegraph", enough: float = 90.0) -> DataFrame:
    """(workspace, process, status) of one side of the index.

    workspaces: workspace, file_num, done.  No files: pending; all done: success; open events:
    running; failed ones: failed below ``enough`` per cent; else success.
    """
    busy, bad = ((1, 2, 3), (4, 5)) if part == "embedding" else ((1, 2), (3,))
    state = F.col(f"{part}_status")
    counted = events.groupBy("workspace").agg(F.count_if(state.isin(*busy)).alias("busy"), F.count_if(state.isin(*bad)).alias("bad"))
    rows = workspaces.join(counted, "workspace", "left").withColumn("process", _progress(F.col("done"), F.col("file_num")))
    said = (
        F.when(F.col("file_num") <= 0, "pending").when(F.col("process") >= 100, "success").when(F.coalesce("busy", F.lit(0)) > 0, "running")
        .when((F.coalesce("bad", F.lit(0)) > 0) & (F.col("process") < enough), "failed").otherwise("success")
    )
    return rows.select("workspace", "process", said.alias("status"))


def all_succeeded(events: DataFrame) -> DataFrame:
    """(workspace, done): no event of the workspace is left in another state than success."""
    return events.groupBy("workspace").agg(F.every((F.col("embedding_status") == 6) & (F.col("codegraph_status") == 4)).alias("done"))


def failed_digest(failed: DataFrame, most: int = 5) -> DataFrame:
    """(workspace, paths, message): the first failed paths, joined by commas, and what is said of the first of them.

    failed: workspace, path, message.  Paths are ranked first, so that no list is longer than ``most``.
    """
    once = failed.groupBy("workspace", "path").agg(F.min("message").alias("message"))
    ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy("workspace").orderBy("path"))).where(F.col("rank") <= most)
    listed = F.array_sort(F.collect_list(F.struct("path", "message")))
    return ranked.groupBy("workspace").agg(listed.alias("first")).select("workspace", F.array_join("first.path", ",").alias("paths"), F.get("first", F.lit(0))["message"].alias("message"))


def index_metrics(files: DataFrame) -> DataFrame:
    """One row over index results (path, symbols, variables, failed): totals; ``failed_paths`` lists the failed ones."""
    return files.agg(
        F.count(F.lit(1)).alias("total_files"), F.sum("symbols").alias("total_symbols"), F.sum("variables").alias("total_variables"),
        F.count_if("failed").alias("failed_files"),
    )


def failed_paths(files: DataFrame) -> DataFrame:
    """(path) of the files that failed, however many, in order."""
    return files.where("failed").select("path").orderBy("path")


def expired_indexes(workspaces: DataFrame, now: Column, enabled: bool = True) -> DataFrame:
    """Workspaces whose index goes: inactive for 3 days with files, or, switched off, for 24 hours."""
    hours = 72 if enabled else 24
    return workspaces.where((F.col("active") == "false") & (F.col("file_num") > 0) & (F.col("updated_at") <= now - F.expr(f"interval {hours} hours"))).select("workspace")
