"""Exact top-k inner products by MaxScore over postings.

The components of a vector are its terms.  A part of the vectors has a postings list for each term:
its rows ordered by their value, read from the top where the query's component is positive and
from the bottom where it is negative.  Terms are ordered by their score bounds; the tail whose
bounds sum to less than what a vector still needs is non-essential.  The essential postings are
traversed, deeper and deeper, until no row that they haven't shown can compete; the other terms are
probed one after the other, only for rows that remain competitive.  The parts' best rows are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import checkpointed, map_arrow

#: Vectors of a part, and bytes of the queries that travel to the tasks at once.  Both bound what a task holds.
PART_ROWS, QUERY_BYTES = 32_768, 32 << 20
#: Entries of each essential postings list that are traversed first, and how many times deeper it gets each time.
FIRST, DEEPER = 64, 4


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """Rows of integers, shorter ones filled with zeros."""
    out = np.zeros((len(column), width), dtype=np.int64)
    flat, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    sizes = np.diff(ends)
    row = np.repeat(np.arange(len(column)), sizes)
    out[row, np.arange(ends[0], ends[-1]) - np.repeat(ends[:-1], sizes)] = flat[ends[0] : ends[-1]]
    return out


class Postings:
    """For each term of a part's vectors its rows in descending order of value."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray):
        order = np.argsort(ids, kind="stable")  # positions follow ids: ties go to the first
        self.ids, self.vectors = ids[order], vectors[order]
        self.lists = np.argsort(-self.vectors, axis=0, kind="stable").astype(np.int32).T.copy()
        self.most, self.least = self.vectors.max(axis=0), self.vectors.min(axis=0)

    def entries(self, term: int, up: bool, start: int, stop: int) -> np.ndarray:
        """Rows start to stop of a list, read from the top (``up``) or from the bottom."""
        rows, n = self.lists[term], len(self.ids)
        return rows[start:stop] if up else rows[n - stop : n - start]

    def value(self, term: int, up: bool, depth: int):
        """The best value that the list still holds below ``depth``."""
        return self.vectors[self.lists[term, depth if up else len(self.ids) - 1 - depth], term]


def best_of(query: np.ndarray, own: int, postings: Postings, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, scores) of the k best rows for one query, by MaxScore; rows of the id ``own`` take no part."""
    n, vectors = len(postings.ids), postings.vectors
    bounds = np.maximum(query * postings.most, query * postings.least)
    order = np.argsort(-bounds, kind="stable")
    tail = np.concatenate([np.cumsum(bounds[order][::-1])[::-1], [0]])  # tail[i]: what the terms from the i-th can add
    seen = np.zeros(n, dtype=bool)
    seen[np.searchsorted(postings.ids, own) : np.searchsorted(postings.ids, own, "right")] = True
    at, scores, depth = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=vectors.dtype), 0
    while depth < n:
        threshold = scores[-1] if len(scores) >= k else None
        # essential: the terms without which no row can reach the threshold
        essential = len(order) if threshold is None else max(1, int((tail < threshold).argmax())) if (tail < threshold).any() else len(order)
        terms, stop = order[:essential], min(n, max(FIRST, depth * DEEPER))
        shown = np.zeros(n, dtype=bool)
        for t in terms.tolist():
            shown[postings.entries(t, query[t] >= 0, depth, stop)] = True
        alive = np.flatnonzero(shown & ~seen)
        seen |= shown
        sums = vectors[np.ix_(alive, terms)] @ query[terms]
        for i in range(essential, len(order) + 1):
            if threshold is not None:
                keep = sums + tail[i] >= threshold  # an equal score may be that of a smaller id
                alive, sums = alive[keep], sums[keep]
            if i == len(order) or not len(alive):
                break
            sums = sums + vectors[alive, order[i]] * query[order[i]]
        at, scores = np.concatenate([at, alive]), np.concatenate([scores, sums])
        best = np.lexsort((at, -scores))[:k]
        at, scores, depth = at[best], scores[best], stop
        if len(scores) >= k and depth < n:
            left = sum(query[t] * postings.value(t, query[t] >= 0, depth) for t in terms.tolist()) + tail[essential]
            if left < scores[-1]:  # rows that no essential list has shown stay below
                break
    return at, scores


def _search(k: int, width: int, sent):
    """mapInArrow function: rows (id, v) to the k best of each part for each of the sent queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows, held = [], [], 0
        for batch in batches:
            for start in range(0, batch.num_rows, PART_ROWS):
                part = batch.slice(start, PART_ROWS)
                if held + part.num_rows > PART_ROWS:
                    yield from answers(np.concatenate(ids), np.concatenate(rows))
                    ids, rows, held = [], [], 0
                ids.append(part.column("id").to_numpy())
                rows.append(_matrix(part.column("v"), width))
                held += part.num_rows
        if held:
            yield from answers(np.concatenate(ids), np.concatenate(rows))

    def answers(ids: np.ndarray, matrix: np.ndarray) -> Iterator[pa.RecordBatch]:
        query_ids, asked = sent.value
        # sums below 2 ** 53 are exact as doubles, which multiply faster
        largest = float(max(abs(int(matrix.max())), abs(int(matrix.min()))))
        exact = np.float64 if width * largest * float(np.abs(asked).max()) < 2.0**53 else np.int64
        postings = Postings(matrix.astype(exact), ids)
        for start in range(0, len(asked), 1024):
            out: list[list[np.ndarray]] = [[], [], []]
            for own, query in zip(query_ids[start : start + 1024].tolist(), asked[start : start + 1024].astype(exact), strict=True):
                at, scores = best_of(query, own, postings, k)
                for column, x in zip(out, (np.full(len(at), own, dtype=np.int64), postings.ids[at], scores.astype(np.int64)), strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=["query_id", "vec_id", "score"])

    return run


def integer_vectors(embeddings: DataFrame) -> DataFrame:
    """(id, v): vec_id and floor(1024 * x) of every component x, as double.

    Rows without vec_id, and vectors that are null or hold null or non-finite components, are left out.
    """
    v = F.col("embedding").cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("id"), v.alias("v"), bad.alias("bad"))
    return rows.where("id is not null and v is not null and not bad").select("id", F.transform("v", lambda x: F.floor(x * 1024.0)).alias("v"))


def top_inner_products(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank from 1, vec_id, score) of each query's k highest integer inner products.

    vectors and queries: rows (id, v) as of ``integer_vectors``; a shorter vector counts as filled
    with zeros.  Every row but those of the query's own id is a candidate; ties go to the smaller
    id; fewer candidates give fewer rows.  Of a repeated query one copy is asked; repeated
    candidates are candidates of their own.  Scores must fit 64 bits.

    No vector is shuffled: every task answers a block of queries from the vectors that it reads, by
    parts of at most PART_ROWS, each of which returns k rows for a query.  Queries go to the tasks
    in blocks of at most QUERY_BYTES, which the driver holds one at a time; with several blocks, each
    block's merged answers are written before the next.  No queries or no vectors give no rows.
    """
    spark = vectors.sparkSession
    asked, wide = queries.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    width = max(1, vectors.agg(F.max(F.size("v"))).first()[0] or 0, wide or 0)
    blocks = max(1, -(-asked * 8 * width // QUERY_BYTES))
    if blocks > 1:
        vectors = checkpointed(vectors)
    once = queries.dropDuplicates(["id"])
    out = None
    for block in range(blocks):
        rows = once.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).select("id", "v").toArrow()
        if not rows.num_rows and out is not None:
            continue
        sent = spark.sparkContext.broadcast((rows.column("id").to_numpy(), _matrix(rows.column("v").combine_chunks(), width)) if rows.num_rows else (np.zeros(0, dtype=np.int64), np.zeros((0, width), dtype=np.int64)))
        found = map_arrow(vectors.select("id", "v"), _search(k, width, sent), "query_id long, vec_id long, score long") if rows.num_rows else spark.createDataFrame([], "query_id long, vec_id long, score long")
        ranked = found.selectExpr("query_id", "row_number() over (partition by query_id order by score desc, vec_id) as rank", "vec_id", "score").where(F.col("rank") <= k)
        if blocks > 1:
            ranked = checkpointed(ranked)
            sent.unpersist()
        out = ranked if out is None else out.unionByName(ranked)
    return out
