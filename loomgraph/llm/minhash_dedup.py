"""MinHash near-duplicate documents with odd sketches.

Distinct word shingles of whole texts give MinHash values for the bands, and one-permutation
samples that are folded into a parity bitmap (an odd sketch).  The XOR population count of two
bitmaps estimates how far two sets are apart; candidates that it puts clearly below the threshold
are dropped before whole sets are compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing
from .cluster import apart, checkpointed, distinct_nodes, keyed_rows, map_arrow, semi_join, without
from .neardup import Similarity, near_components

#: Each band is this many MinHash values; a pair at similarity 0.8 misses all bands with probability (1 - 0.8 ** ROWS) ** BANDS = 3e-6.
ROWS, BANDS = 4, 24
#: Samples folded into a bitmap, and its 64-bit words.
SAMPLES, SKETCH_WORDS = 512, 16


#: Seeds of a set's two 64-bit keys.
KEY_SEEDS = (0xA0761D6478BD642F, 0xE7037ED1A0B428DB)


def _keys(flat: np.ndarray, bounds: np.ndarray) -> list[pa.Array]:
    return [pa.array(hashing.set_keys(flat, bounds, seed).view(np.int64)) for seed in KEY_SEEDS]


def _flat(texts: list, width: int) -> tuple[np.ndarray, np.ndarray]:
    sets = list(hashing.word_shingles(texts, width))
    return np.concatenate([np.zeros(0, np.uint64), *sets]), np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int64)


def _signatures(width: int, carried: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                flat, bounds = _flat(part.column("text").to_pylist(), width)
                bands = hashing.band_keys(hashing.minimum_hashes(flat, bounds, ROWS * BANDS), ROWS).view(np.int64)
                values, filled = hashing.one_permutation(flat, bounds, SAMPLES)
                sketch = hashing.odd_sketches(values, filled, 64 * SKETCH_WORDS).view(np.int64)
                columns = [part.column("doc_id"), pa.array(np.diff(bounds)), *_keys(flat, bounds), pa.array(filled.sum(axis=1).astype(np.int64))]
                columns += [pa.array(bands[:, i].copy()) for i in range(BANDS)] + [pa.array(sketch[:, i].copy()) for i in range(SKETCH_WORDS)]
                yield pa.RecordBatch.from_arrays([*columns, *(part.column(c) for c in carried)], names=[*_NAMES, *carried])

    return run


def _keyed(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, bounds = _flat(batch.column("text").to_pylist(), width)
            yield pa.RecordBatch.from_arrays([*_keys(flat, bounds), batch.column("text")], names=["id", "check", "text"])

    return run


_NAMES = ["doc_id", "n", "id", "check", "filled", *[f"k{i}" for i in range(BANDS)], *[f"s{i}" for i in range(SKETCH_WORDS)]]


def _classified(docs: DataFrame, carried: list[str], shingle_words: int, num: int, den: int) -> DataFrame:
    """Every row's doc_id, n_shingles, component_id and first (the one row of its class that stays), and the carried long columns."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *carried)
    schema = "doc_id long, " + ", ".join(f"{c} long" for c in [*_NAMES[1:], *carried])
    signed = checkpointed(map_arrow(docs, _signatures(shingle_words, carried), schema).withColumn("row", F.monotonically_increasing_id()))
    # nulls come after all others here: a class takes its name from a row that has one
    named_first = F.coalesce(F.col("doc_id").cast("decimal(20,0)"), F.lit("9223372036854775808").cast("decimal(20,0)"))
    facts = [F.min("doc_id").alias("owner"), F.min_by("row", named_first).alias("row"), *[F.min(c).alias(c) for c in ["n", *_NAMES[4:]]]]
    worded, nodes, torn = distinct_nodes(signed.where("n > 0"), *facts)
    signed = worded.unionByName(signed.where("n = 0"))

    def texts_of(ids: DataFrame) -> DataFrame:
        wanted = checkpointed(nodes.join(ids.withColumnRenamed("id", "id_"), F.col("id") == F.col("id_"), "left_semi").select(F.col("id").alias("id_"), "owner"))
        owned = semi_join(docs, wanted.select("owner"), F.col("doc_id").eqNullSafe(F.col("owner")), wanted.count())
        # a doc_id may be repeated with other texts: the keys, made anew, tell which text is meant
        keyed = apart(map_arrow(owned.select("text"), _keyed(shingle_words), "id long, check long, text string"), torn)
        return keyed.join(wanted.select("id_"), F.col("id") == F.col("id_"), "left_semi").groupBy("id").agg(F.max("text").alias("text"))

    similarity = Similarity(partial(hashing.word_sets, width=shingle_words), num, den, SKETCH_WORDS, SAMPLES)
    roots = near_components(nodes, BANDS, similarity, texts_of)
    classes = nodes.select("id", "owner", "row").join(roots.withColumnRenamed("id", "id_"), F.col("id") == F.col("id_"), "left").select("id", "owner", "row", F.coalesce("root", "id").alias("root"))
    order = F.coalesce(F.col("owner").cast("decimal(20,0)"), F.lit("9223372036854775808").cast("decimal(20,0)"))
    least = classes.groupBy("root").agg(F.min("owner").alias("component_id"), F.min_by("row", order).alias("winner"))
    named = classes.join(least.withColumnRenamed("root", "root_"), F.col("root") == F.col("root_")).select(F.col("id").alias("id_"), "component_id", "winner")
    out = signed.select("doc_id", F.col("n").alias("n_shingles"), "id", "row", *carried).join(named, (F.col("id") == F.col("id_")) & (F.col("n_shingles") > 0), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("row") == F.col("winner"), F.lit(True)).alias("first"), *carried)


def near_duplicate_documents(docs: DataFrame, *, shingle_words: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """Classes of documents whose shingle sets have a Jaccard similarity of at least num / den.

    docs: doc_id and text; further columns, whatever their names, are not read.  Words are runs
    without ASCII white space, A-Z in lower case.  A text with fewer words than a shingle is one
    shingle; a null text, an empty one or one without words has no shingles and no links.  Texts
    are compared whole, however long.  Sets are one only where two 64-bit keys agree.

    Returns one row for each row of docs: doc_id, n_shingles, component_id (the least doc_id of the
    class, its own without links), kept (doc_id = component_id) and first (the one row of its class
    that stays: of rows with the least doc_id any one).  A null doc_id can't be named by a class:
    its component_id is null, and kept is true.  Repeated rows share their class; an empty table
    gives no rows.
    """
    out = _classified(docs, [], shingle_words, num, den)
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), "first")


def without_near_duplicates(docs: DataFrame, *, shingle_words: int = 5) -> DataFrame:
    """``docs`` (columns and all) less all rows of a class but one, that with the least doc_id (null: the last).

    Rows are told apart by doc_id and text, so that another row of the same doc_id stays if its
    text is no near copy; of rows equal in both one stays.  Rows without words pass.
    """
    docs, keys = keyed_rows(docs, F.length(F.trim(F.translate("text", "\t\n\x0b\f\r", "     "))) > 0)
    classes = _classified(docs.select("doc_id", "text", F.col(keys[0]).alias("row1"), F.col(keys[1]).alias("row2")), ["row1", "row2"], shingle_words, 8, 10)
    return without(docs, keys, classes.where("not first"))
