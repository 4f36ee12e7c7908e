"""Distributed union-find: connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import checkpointed, scoped

#: Edges of a partition between the rounds.
PART_EDGES = 100_000


def _least(edges: DataFrame) -> DataFrame:
    """(u, v, m): every edge with the least of u and u's neighbours; combined before the shuffle."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "u_")
    return edges.join(least, F.col("u") == F.col("u_")).select("u", "v", F.least("u", "m").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to the least it knows."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node (u > v holds) links its smaller neighbours and itself to the least of them."""
    known = _least(edges)
    moved = known.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(known.select("u", F.col("m").alias("v"))).distinct()


@scoped
def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, root) for each node of ``edges`` (columns a and b of one ordered type): root is the
    least node of its component.

    Self-loops, repeated edges and nulls are ignored; no edges give no rows.  Each round halves
    the depth of the trees or better; links stay distributed and each round is checkpointed.
    """
    now = checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    for _ in range(max_rounds):
        found = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if found == state or not found[0]:
            break
        parts = -(-found[0] // PART_EDGES)  # what is left of the edges is small: few files
        state, now = found, checkpointed(_small_star(_large_star(now.coalesce(parts))).coalesce(parts))
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    return checkpointed(now.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("root"))).distinct())


def extended(classes: DataFrame, links: DataFrame) -> DataFrame:
    """classes (id, root) after further links (a, b): only the links between classes go through union-find."""
    known = classes.select(F.col("id").alias("id_"), F.col("root").alias("root_"))
    for x in "ab":
        links = links.join(known, F.col(x) == F.col("id_"), "left").withColumn(x, F.coalesce("root_", x)).drop("id_", "root_")
    links = checkpointed(links.where("a <> b").distinct())
    if links.isEmpty():
        return classes
    upper = checkpointed(connected_components(links).select(F.col("id").alias("up"), F.col("root").alias("top")))
    moved = classes.join(upper, F.col("root") == F.col("up"), "left").select("id", F.coalesce("top", "root").alias("root"))
    fresh = upper.join(known, F.col("up") == F.col("id_"), "left_anti").select(F.col("up").alias("id"), F.col("top").alias("root"))
    return checkpointed(moved.unionByName(fresh))
