"""Benchmark decontamination by a prefix-filtered join of item windows with documents.

A window occurs in a document only if its rarest word does: for containment of all its words the
necessary prefix of the words, ordered by rarity, is one word long.  Document words are joined with
these prefix words; position bounds drop windows that would start before the text or end after
it; what is left is verified word by word.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import checkpointed, kept_rows, map_arrow, row_keys

#: Words of a window.
WINDOW = 10
#: Most windows that are sent to the executors at once (a few hundred bytes each); more are joined part by part.
WINDOWS_AT_ONCE = 200_000

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: str | None) -> list[bytes]:
    """Words (UTF-8) of a text, A-Z lower-cased; a null text has none."""
    return _WORD.findall(text.encode("utf-8", "replace").lower()) if text else []


def windows_of(words: list[bytes], size: int = WINDOW) -> list[tuple[bytes, ...]]:
    """All windows of ``size`` words; fewer words, but not none, are one window."""
    return [tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []


def _item_windows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, b" ".join(w)) for i, t in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True) for w in dict.fromkeys(windows_of(words_of(t), size))]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], names=["item_id", "words"])

    return run


def _frequencies(wanted):
    """In how many documents each of the wanted words occurs: one row for each word and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, found = wanted.value, Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                found.update(words.intersection(words_of(text)))
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])

    return run


def _found(text: str | None, by_word: dict) -> tuple[int, list[tuple[int, int]], set[str]]:
    """(words of a text, spans of the windows in it, their items); by_word: rarest word -> [(its place in the window, words of the window, its items)]."""
    words = words_of(text)
    n, spans, items = len(words), [], set()
    if not by_word.keys().isdisjoint(words):
        for at, word in enumerate(words):
            for place, window, owners in by_word.get(word, ()):
                start = at - place
                if start >= 0 and start + len(window) <= n and words[start : start + len(window)] == window:
                    spans.append((start, start + len(window)))
                    items.update(owners)
    return n, spans, items


def _merged(spans: list[tuple[int, int]]) -> list[int]:
    """Maximal runs, (first, end) one after the other."""
    joined: list[list[int]] = []
    for a, b in sorted(spans):
        if joined and a <= joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], b)
        else:
            joined.append([a, b])
    return [x for s in joined for x in s]


def _hits(index, kept: list[str], hit_only: bool):
    """mapInArrow function: rows (kept columns, text) to (kept columns, n_words, spans, items), all or those with hits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [_found(text, index.value) for text in batch.column("text").to_pylist()]
            columns = [pa.array([x[0] for x in out], pa.int64()), pa.array([_merged(x[1]) for x in out], pa.list_(pa.int64())), pa.array([sorted(x[2]) for x in out], pa.list_(pa.string()))]
            made = pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *columns], names=[*kept, "n_words", "spans", "items"])
            yield made.filter(pa.array([bool(x[1]) for x in out], pa.bool_())) if hit_only else made

    return run


def _union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, n_words, found: the spans and items of each pass) to maximal spans and sorted items."""
    for batch in batches:
        spans, items = [], []
        for found in batch.column("found").to_pylist():
            parts = [p["spans"] for p in found or ()]
            spans.append(_merged([x for p in parts for x in zip(p[0::2], p[1::2], strict=True)]))
            items.append(sorted({i for p in found or () for i in p["items"]}))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))], names=["doc_id", "n_words", "spans", "items"])


def contaminated_words(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, at_once: int = WINDOWS_AT_ONCE) -> DataFrame:
    """Which words of each document lie in an occurrence of a benchmark item's window.

    docs: doc_id and text, benchmark: item_id and text; further columns, whatever their names, are
    not read.  Words are runs of 0-9, a-z and characters beyond ASCII, A-Z lower-cased; windows are
    ``window`` words, or a shorter item as a whole; an item without words has none.

    Returns one row for each row of docs: doc_id, n_words, spans (first word and end of every
    maximal hit run, one after the other), items (sorted item_ids, as strings, of the windows that
    occur; a null item_id hits words but isn't listed).  A null or empty text has no words; an
    empty benchmark hits nothing, an empty docs gives no rows.  Rows alike, with or without
    doc_id, have hits alike; texts are read whole, however long.

    The benchmark's windows travel to the tasks at most ``at_once`` at a time.  A larger benchmark
    takes several passes, each over all texts; a pass writes the rows with hits and no texts, and
    the passes' hits are joined with the rows by two hashes of doc_id and text.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    indexes = _indexes(texts, benchmark, window, at_once)
    first = next(indexes)
    second = next(indexes, None)
    if second is None:
        return map_arrow(texts, _hits(first, ["doc_id"], False), "doc_id long, n_words long, spans array<long>, items array<string>")
    keyed = texts.select(*[k.alias(c) for k, c in zip(row_keys(texts), ("key1", "key2"), strict=True)], "text")
    found = None
    for index in chain((first, second), indexes):
        hits = checkpointed(map_arrow(keyed, _hits(index, ["key1", "key2"], True), "key1 long, key2 long, n_words long, spans array<long>, items array<string>").dropDuplicates(["key1", "key2"]))
        found = hits if found is None else found.unionByName(hits)
    by_row = found.groupBy("key1", "key2").agg(F.collect_list(F.struct("spans", "items")).alias("found"))  # a struct for each pass
    numbered = texts.select("doc_id", *[k.alias(c) for k, c in zip(row_keys(texts), ("row1", "row2"), strict=True)], "text")
    counted = map_arrow(numbered, _counted, "doc_id long, row1 long, row2 long, n_words long")
    joined = counted.join(by_row, (F.col("row1") == F.col("key1")) & (F.col("row2") == F.col("key2")), "left")
    return map_arrow(joined.select("doc_id", "n_words", "found"), _union, "doc_id long, n_words long, spans array<long>, items array<string>")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = pa.array([len(words_of(t)) for t in batch.column("text").to_pylist()], pa.int64())
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "row1", "row2")), n], names=["doc_id", "row1", "row2", "n_words"])


def _indexes(texts: DataFrame, benchmark: DataFrame, window: int, at_once: int):
    """Broadcast indexes, by rarest word, of at most ``at_once`` windows each; one at least."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    windows = map_arrow(items, _item_windows(window), "item_id string, words binary").groupBy("words").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    part: list[tuple[list[bytes], list[str]]] = []
    for row in windows.orderBy("words").toLocalIterator():  # the driver holds one part at a time
        if len(part) == at_once:
            yield _index(texts, part)
            part = []
        part.append((bytes(row["words"]).split(b" "), row["items"]))
    yield _index(texts, part)


def _index(texts: DataFrame, windows: list[tuple[list[bytes], list[str]]]):
    context = texts.sparkSession.sparkContext
    often: dict[bytes, int] = {}
    if windows:
        vocabulary = context.broadcast(frozenset(w for window, _ in windows for w in window))
        counted = map_arrow(texts.select("text"), _frequencies(vocabulary), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
        often = {bytes(r["word"]): r["n"] for r in counted.collect()}
    index: dict[bytes, list] = {}
    for window, owners in windows:
        place = min(range(len(window)), key=lambda i: (often.get(window[i], 0), window[i], i))
        if window[place] in often:  # a word that no document holds rules its windows out
            index.setdefault(window[place], []).append((place, window, owners))
    return context.broadcast(index)


def without_contaminated(docs: DataFrame, benchmark: DataFrame, *, at_once: int = WINDOWS_AT_ONCE) -> DataFrame:
    """``docs`` (columns and all) less the rows that hold a benchmark window.

    Each row is judged by its own text where it is read, once for each part of the benchmark;
    doc_ids, null or repeated, don't matter.  Null texts pass.
    """
    texts = docs.select(F.col("text").cast("string").alias("text"))
    for index in _indexes(texts, benchmark, WINDOW, at_once):
        docs = kept_rows(docs, _clean(index))
    return docs


def _clean(index):
    def judge():
        by_word = index.value
        return lambda batch: pa.array([not _found(text, by_word)[1] for text in batch.column("text").to_pylist()], pa.bool_())

    return judge
