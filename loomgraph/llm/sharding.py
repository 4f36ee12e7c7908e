"""Vector bin packing of documents into shards, balancing bytes, tokens and rows together."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import checkpointed

#: Groups of more than 1 / HEAVY of any resource are placed first, by the driver; those of each further size class are at least 1 / STEP of the class before.
HEAVY, STEP = 8_000, 8
#: Groups that are placed together in one task, about.
TOGETHER = 20_000
#: Rows that are numbered together.
NUMBERED = 500_000

_RESOURCES = ("bytes", "tokens", "rows")


def place(demand: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The shard of each row (bytes, tokens, rows as shares of a shard) of ``demand``; takes from ``left``.

    The largest goes first.  Each is placed where the dot product of its demand and the residual
    capacity is highest; shards that it would overfill in some resource come after all others, the
    least overfilled first.  Ties go to the first shard.
    """
    out = np.zeros(len(demand), dtype=np.int64)
    for i in np.lexsort((np.arange(len(demand)), -demand.max(axis=1))):
        d = demand[i]
        over = (d - left).max(axis=1)
        fits = over <= 1e-9
        out[i] = shard = int(np.where(fits, left @ d, -1e9).argmax()) if fits.any() else int(over.argmin())
        left[shard] -= d
    return out


_UNIT = "g1 long, g2 long, part long, bytes long, tokens long, rows long"


def _placed_part(capacity: list[float], left: np.ndarray):
    """applyInArrow function: a part of a size class to the shards of its groups; the part has its share of the residuals."""

    def run(units: pa.Table) -> pa.Table:
        units = units.sort_by([("g1", "ascending"), ("g2", "ascending"), ("part", "ascending")])
        demand = np.stack([units.column(c).to_numpy() for c in _RESOURCES], axis=1) / np.array(capacity)
        shard = place(demand, left.copy())
        return units.select(["g1", "g2", "part", *_RESOURCES]).append_column("shard", pa.array(shard.astype(np.int32)))

    return run


def _placed(units: DataFrame, capacity: list[float], shards: int) -> tuple[DataFrame, DataFrame]:
    """(heavy, light) groups with their shards: each group by its own dot product, class by class, the largest class first.

    units: g1, g2, part, their bytes, tokens and rows, and class.  Class 0 is placed by the driver.  Each
    further class is dealt by hash into parts of about TOGETHER groups; a part is placed in one
    task, with its share of what the classes before have left in each shard.
    """
    spark = units.sparkSession
    left = np.ones((shards, len(_RESOURCES)))
    sizes = {r["class"]: r["count"] for r in units.groupBy("class").count().collect()}
    rows = sorted((tuple(r) for r in units.where("class = 0").select("g1", "g2", "part", *_RESOURCES).collect()), key=str)  # at most 3 * HEAVY
    shard = place(np.array([r[3:] for r in rows], dtype=float).reshape(-1, len(_RESOURCES)) / np.array(capacity), left).tolist()
    heavy = spark.createDataFrame([(*r, s) for r, s in zip(rows, shard, strict=True)], f"{_UNIT}, shard int")
    light = None
    for level in sorted(x for x in sizes if x > 0):
        parts = max(1, round(sizes[level] / TOGETHER))
        of = units.where(F.col("class") == level).select("g1", "g2", "part", *_RESOURCES, F.pmod(F.xxhash64("g2", "g1", "part"), F.lit(parts)).alias("dealt"))
        made = checkpointed(of.groupBy("dealt").applyInArrow(_dropping(_placed_part(capacity, left / parts)), f"{_UNIT}, shard int"))
        for r in made.groupBy("shard").agg(*[F.sum(c).alias(c) for c in _RESOURCES]).collect():
            left[r["shard"]] -= np.array([r[c] for c in _RESOURCES], dtype=float) / np.array(capacity)
        light = made if light is None else light.unionByName(made)
    return heavy, light if light is not None else spark.createDataFrame([], f"{_UNIT}, shard int")


def _dropping(run):
    return lambda table: run(table.drop_columns(["dealt"]))


def shard_documents(docs: DataFrame, shards: int = 40) -> DataFrame:
    """Every document's shard, with near-equal bytes, tokens and rows in all of them.

    docs: doc_id and text; further columns, whatever their names, are not read.  A document's size
    is the UTF-8 bytes of its text (null: none) plus 16; its tokens are runs without white space.
    Documents of equal text (null and empty ones are two texts) form a group, which stays in one
    shard unless it is more than a shard's share of the bytes, tokens or rows: no shard could hold
    such a group evenly, so it is split by doc_id into the fewest parts that fit.

    Groups are placed by vector bin packing, the largest first, by size classes: ``_placed``.
    Returns one row for each row of docs: doc_id, size, tokens, text_crc32 (of the UTF-8 text,
    null: 0), shard, slot (gapless from 0 in its shard, by doc_id where a shard is small; ties in
    any order).  Repeated rows are rows of one group; a null doc_id is a doc_id like others; a very
    long text is a group that may fill a shard by itself; an empty table gives no rows.
    """
    text = F.col("text").cast("string")
    raw = F.coalesce(text, F.lit("")).cast("binary")
    # runs of ASCII white space become one space, whose number in the trimmed text tells the words
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "[ \\t\\n\\x0B\\f\\r]+", " "))
    words = F.when(F.length(flat) == 0, 0).otherwise(1 + F.length(flat) - F.length(F.replace(flat, F.lit(" "), F.lit(""))))
    rows = checkpointed(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(raw) + 16).cast("long").alias("size"),
        words.cast("long").alias("tokens"),
        F.crc32(raw).alias("text_crc32"),
        F.xxhash64(text, F.lit(1)).alias("g1"),
        F.xxhash64(F.lit(2), text).alias("g2"),
    ))
    total = rows.agg(F.sum("size"), F.sum("tokens"), F.count(F.lit(1))).first()
    capacity = [max(1.0, (x or 0) / shards) for x in total]
    sums = [F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")]
    demand = F.greatest(*[F.col(c) / F.lit(m) for c, m in zip(_RESOURCES, capacity, strict=True)])
    groups = checkpointed(rows.groupBy("g1", "g2").agg(*sums))
    # at most 3 * shards groups exceed a shard; a tenth of a shard makes room for uneven parts
    large = groups.where((demand > 1) & (F.col("rows") > 1)).select(F.col("g1").alias("g1_"), F.col("g2").alias("g2_"), F.least(F.ceil(demand * 10 / 9) + 1, F.col("rows")).alias("parts"))
    large = checkpointed(large)
    parted = rows.join(F.broadcast(large), (F.col("g1") == F.col("g1_")) & (F.col("g2") == F.col("g2_")), "left").select(*rows.columns, F.pmod(F.xxhash64("doc_id"), F.coalesce("parts", F.lit(1))).alias("part"))
    torn = large.select("g1_", "g2_")
    whole = groups.join(F.broadcast(torn), (F.col("g1") == F.col("g1_")) & (F.col("g2") == F.col("g2_")), "left_anti").select("g1", "g2", F.lit(0).cast("long").alias("part"), *_RESOURCES)
    pieces = parted.join(F.broadcast(torn), (F.col("g1") == F.col("g1_")) & (F.col("g2") == F.col("g2_")), "left_semi").groupBy("g1", "g2", "part").agg(*sums)
    # class 0: more than 1 / HEAVY of a resource; then one class for each factor of STEP
    level = F.greatest(F.lit(0), F.ceil(-F.log(demand * (HEAVY / shards)) / math.log(STEP))).cast("int")
    units = checkpointed(whole.unionByName(pieces).withColumn("class", level))
    heavy, light = _placed(units, capacity, shards)
    on = (F.col("g1") == F.col("h1")) & (F.col("g2") == F.col("h2")) & (F.col("part") == F.col("hpart"))
    named = [F.col("g1").alias("h1"), F.col("g2").alias("h2"), F.col("part").alias("hpart"), F.col("shard")]
    keys = heavy.select(*named)
    columns = ["doc_id", "size", "tokens", "text_crc32", "shard"]
    # rows of heavy groups, which may be many, meet a bounded broadcast; the light groups are joined by key
    placed = parted.join(F.broadcast(keys), on).select(*columns).unionByName(parted.join(F.broadcast(keys.drop("shard")), on, "left_anti").join(light.select(*named), on).select(*columns))
    # slots: ranges of a shard's rows, dealt by hash, are numbered on their own from where the one before ends
    ranges = max(1, -(-(total[2] or 0) // (shards * NUMBERED)))
    dealt = checkpointed(placed.withColumn("range", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(ranges)).cast("int")))
    counts = {(r["shard"], r["range"]): r["count"] for r in dealt.groupBy("shard", "range").count().collect()}
    first = docs.sparkSession.createDataFrame(_begins(counts), "s_ int, g_ int, begin long")
    numbered = dealt.selectExpr("*", "row_number() over (partition by shard, range order by doc_id, text_crc32) - 1 as at")
    numbered = numbered.join(F.broadcast(first), (F.col("shard") == F.col("s_")) & (F.col("range") == F.col("g_")))
    return numbered.select("doc_id", "size", "tokens", "text_crc32", "shard", (F.col("begin") + F.col("at")).alias("slot"))


def _begins(counts: dict[tuple[int, int], int]) -> list[tuple[int, int, int]]:
    """(shard, range, rows of the shard's ranges before it)."""
    out, at = [], {}
    for s, g in sorted(counts):
        out.append((s, g, at.get(s, 0)))
        at[s] = at.get(s, 0) + counts[s, g]
    return out
