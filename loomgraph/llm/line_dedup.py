"""Fuzzy line deduplication: MinHash over character shingles, exact Jaccard check, union-find."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing
from .cluster import BROADCAST_KEYS, apart, checkpointed, distinct_nodes, free_name, keyed_rows, map_arrow, semi_join
from .neardup import Similarity, near_components

#: Characters of a shingle.
WIDTH = 8
#: Each band is this many samples; independent samples would miss a pair at similarity 0.8 with probability (1 - 0.8 ** ROWS) ** BANDS = 0.3 %, one at 0.9 with 0.003 %; densified ones of short lines miss more (README).
ROWS, BANDS = 3, 8
#: More than the lines of any text.
LINES = 1 << 32


def _signatures(kept: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [batch.column(c) for c in kept]
            texts = batch.column("text").to_pylist()
            for start, end, flat, bounds in hashing.char_windows(texts, WIDTH):
                values, filled = hashing.one_permutation(flat, bounds, ROWS * BANDS)
                bands = hashing.band_keys(hashing.densified(values, filled), ROWS).view(np.int64)
                sizes = np.maximum(np.diff(bounds) - WIDTH + 1, np.minimum(np.diff(bounds), 1))
                columns = [c.slice(start, end - start) for c in keep] + [pa.array(sizes)] + [pa.array(bands[:, i].copy()) for i in range(BANDS)]
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, "n", *[f"k{i}" for i in range(BANDS)]])

    return run


def text_hash(text: F.Column) -> F.Column:
    """The 64-bit hash of a line by which equal lines meet (a second one tells apart what it merges)."""
    return F.xxhash64(text)


def lines_of(docs: DataFrame, *carried: str) -> DataFrame:
    """(doc_id, line_no from 0, text: trimmed and lower-cased, id and check: its hashes, carried columns); a null text has no lines."""
    plain = F.lower(F.replace(F.replace(F.col("text").cast("string"), F.lit("\t"), F.lit(" ")), F.lit("\r"), F.lit(" ")))
    split = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *carried, F.posexplode(F.split(plain, "\n", -1)).alias("line_no", "line"))
    lines = split.select("doc_id", "line_no", F.trim("line").alias("text"), *carried)
    return lines.withColumn("id", text_hash(F.col("text"))).withColumn("check", F.xxhash64(F.lit(1), "text"))


def _marked(docs: DataFrame, carried: list[str], num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """(every line that isn't blank, with the first line of its component and whether it is that; the blank lines)."""
    lines = lines_of(docs, *carried)
    compared = lines.where("text <> ''")
    schema = "doc_id long, line_no int, id long, check long" + "".join(f", {c} long" for c in carried) + ", n long, " + ", ".join(f"k{i} long" for i in range(BANDS))
    kept = ["doc_id", "line_no", "id", "check", *carried]
    signed = checkpointed(map_arrow(compared.select(*kept, "text"), _signatures(kept), schema).withColumn("row", F.monotonically_increasing_id()))
    # the order of lines as one number, which aggregates without sorting; lines of rows without doc_id come last
    place = F.coalesce(F.col("doc_id").cast("decimal(20,0)"), F.lit("9223372036854775808").cast("decimal(20,0)")) * F.lit(LINES).cast("decimal(10,0)") + F.col("line_no").cast("decimal(10,0)")
    facts = [F.count(F.lit(1)).alias("times"), F.min(place).alias("place"), F.min_by("row", place).alias("row"), *[F.min(c).alias(c) for c in ["n", *[f"k{i}" for i in range(BANDS)]]]]
    signed, nodes, torn = distinct_nodes(signed, *facts)

    def texts_of(ids: DataFrame) -> DataFrame:
        wanted = checkpointed(ids.select(F.col("id").alias("id_")))
        found = semi_join(apart(compared.select("id", "check", "text"), torn), wanted, F.col("id") == F.col("id_"), wanted.count())
        return found.groupBy("id").agg(F.max("text").alias("text"))

    similarity = Similarity(partial(hashing.char_sets, width=WIDTH), num, den, sized=False)
    roots = near_components(nodes, BANDS, similarity, texts_of)
    linked = nodes.select("id", "times", "place", "row").join(roots.withColumnRenamed("id", "id_"), F.col("id") == F.col("id_"), "left")
    linked = checkpointed(linked.where("times > 1 or root is not null").select("id", F.coalesce("root", "id").alias("root"), "place", "row"))
    few = linked.count() <= BROADCAST_KEYS
    first = linked.groupBy("root").agg(F.min("place").alias("least"), F.min_by("row", "place").alias("winner")).withColumnRenamed("root", "root_")
    of_node = linked.join(first, F.col("root") == F.col("root_"))
    doc = F.floor(F.col("least") / F.lit(LINES).cast("decimal(10,0)"))
    named = of_node.select(F.col("id").alias("id_"), "winner", F.when(doc < F.lit("9223372036854775808").cast("decimal(20,0)"), doc.cast("long")).alias("first_doc"), F.pmod("least", F.lit(LINES).cast("decimal(10,0)")).cast("int").alias("first_line"))
    joined = signed.select("doc_id", "line_no", "id", "row", *carried).join(F.broadcast(named) if few else named, F.col("id") == F.col("id_"), "left")
    own = F.col("winner").isNull()
    return joined.select(
        "doc_id", "line_no", F.when(own, F.col("doc_id")).otherwise(F.col("first_doc")).alias("first_doc_id"),
        F.when(own, F.col("line_no")).otherwise(F.col("first_line")).alias("first_line_no"), (own | (F.col("row") == F.col("winner"))).alias("kept"), *carried,
    ), lines.where("text = ''")


def duplicate_lines(docs: DataFrame, *, num: int = 8, den: int = 10) -> DataFrame:
    """Components of lines whose sets of 8-character shingles have a Jaccard similarity of num / den or more.

    docs: doc_id and text; further columns, whatever their names, are not read.  Lines end at
    "\n"; they are compared trimmed and lower-cased, whatever their length: one of fewer than 8
    characters is its own only shingle.  Blank lines are never compared and always kept.

    Returns one row for each line: doc_id, line_no, first_doc_id and first_line_no (the least line
    of its component, its own without links) and kept (it is that line).  A null text has no lines,
    an empty one has a blank line; an empty table gives no rows; a very long text is only as costly
    as its lines.  Lines of rows without doc_id come last.  Rows repeated as a
    whole repeat their lines, of which one alone is marked as kept (ties: any).
    """
    long, blank = _marked(docs, [], num, den)
    return long.unionByName(blank.select("doc_id", "line_no", F.col("doc_id").alias("first_doc_id"), F.col("line_no").alias("first_line_no"), F.lit(True).alias("kept")))


def without_duplicate_lines(docs: DataFrame) -> DataFrame:
    """``docs`` (columns and all) with every line dropped that ``duplicate_lines`` doesn't keep.

    Rows that lose no line are passed on as they are.  A row that loses every line that isn't
    blank is dropped, and so are all but one of rows equal in doc_id and text; n_chars, where it
    exists, follows the text.  Rows are told apart by doc_id and text: another row's lines count
    for nothing, even where its doc_id is the same or null.  Null and blank texts pass.
    """
    docs, keys = keyed_rows(docs, F.length(F.trim(F.translate("text", "\t\r\n", "   "))) > 0)
    marked, _ = _marked(docs.select("doc_id", "text", F.col(keys[0]).alias("row1"), F.col(keys[1]).alias("row2")), ["row1", "row2"], 8, 10)
    of, lost = [free_name(docs, "of1"), free_name(docs, "of2")], free_name(docs, "lost")
    lists = marked.where("not kept").groupBy(F.col("row1").alias(of[0]), F.col("row2").alias(of[1])).agg(F.collect_set(F.col("line_no").cast("int")).alias(lost))
    joined = docs.join(lists, (F.col(keys[0]) == F.col(of[0])) & (F.col(keys[1]) == F.col(of[1])), "left")
    rest = F.filter(F.split("text", "\n", -1), lambda line, i: ~F.array_contains(F.col(lost), i))
    text = F.when(F.col(lost).isNull(), F.col("text")).otherwise(F.array_join(rest, "\n"))
    columns = [text.alias("text") if c == "text" else F.col(c) for c in docs.columns if c not in keys]
    out = joined.where(F.col(lost).isNull() | F.exists(rest, lambda line: F.length(F.trim(F.translate(line, "\t\r", "  "))) > 0)).select(*columns)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
