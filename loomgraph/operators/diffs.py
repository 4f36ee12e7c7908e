"""Differences of hash trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def tree_diff(local: DataFrame, remote: DataFrame, *, deletes: bool = True) -> DataFrame:
    """(path, status add, modify or delete, hash: the local one, empty for delete) of what differs."""
    a, b = local.select("path", F.col("hash").alias("l")), remote.select("path", F.col("hash").alias("r"))
    both = a.join(b, "path", "full_outer" if deletes else "left")
    status = F.when(F.col("r").isNull(), "add").when(F.col("l").isNull(), "delete").when(F.col("l") != F.col("r"), "modify")
    return both.withColumn("status", status).where("status is not null").select("path", "status", F.coalesce("l", F.lit("")).alias("hash"))


def batches(changes: DataFrame, size: int = 20) -> DataFrame:
    """changes with a batch number: those of one status in order of path, ``size`` at a time."""
    w = Window.partitionBy("status").orderBy("path")
    return changes.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size).cast("long"))


def overlay(base: DataFrame, top: DataFrame) -> DataFrame:
    """(path, hash) of both trees; top wins."""
    a, b = base.select("path", F.col("hash").alias("l")), top.select("path", F.col("hash").alias("r"))
    return a.join(b, "path", "full_outer").select("path", F.coalesce("r", "l").alias("hash"))
