"""Lineage cuts and size-checked joins that survive lost executors."""

from __future__ import annotations

import ctypes
import gc
import re
import uuid
import weakref
from collections.abc import Callable, Iterator
from contextvars import ContextVar
from functools import wraps

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import checkpoint_folder

#: Has a query's shuffle files removed when it is done; set for the steps that write a table.
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Most keys that a join may broadcast: 16 bytes each, so 16 MB before hashing.
BROADCAST_KEYS = 1_000_000

#: Bytes of an Arrow batch: two workers of an executor and the JVM hold a few of them each.
ARROW_BATCH = "4m"


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``df.mapInArrow(run, schema)`` over small batches, which the session keeps from now on.

    A worker gives its free memory back after each task, and before the first task of another
    operator what it ``held``: it lives on, beside a JVM that may by then need the room.
    """
    return _mapped(df, run, schema, run.__module__)


def _mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType, owner: str) -> DataFrame:
    """``map_arrow`` for the operator in the module ``owner``."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if df.sparkSession.conf.get(key, None) != ARROW_BATCH:
        df.sparkSession.conf.set(key, ARROW_BATCH)

    def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun(owner)
        yield from run(batches)
        trim()

    return df.mapInArrow(trimmed, schema)


def held(key: str, make: Callable[[], object]):
    """What ``make`` returned at the first call with ``key``; a worker keeps it until a task of another operator begins."""
    if key not in _held:
        _held[key] = make()
    return _held[key]


def begun(owner: str) -> None:
    """A task of the operator in the module ``owner`` begins here: what tasks of another one held goes."""
    if _owner[0] != owner:
        _owner[0] = owner
        _held.clear()
        trim()


#: What this process holds, and for the tasks of which module.
_held: dict[str, object] = {}
_owner = [""]


def trim() -> None:
    """Return freed memory to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or a longer one that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written as a Parquet table in the shared checkpoint folder, and read from there.

    This cuts the lineage: lost executors cost nothing that is written.  Columns that a later step
    doesn't use aren't read again.  The shuffle files of the step go when it is written.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/table-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN_UP, None)
    spark.conf.set(_CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEAN_UP) if before is None else spark.conf.set(_CLEAN_UP, before)
    table = spark.read.schema(df.schema).parquet(path)
    if _written.get() is not None:
        _written.get().append(path)
    _path_of[id(table)] = path
    weakref.finalize(table, _path_of.pop, id(table), None)
    return table


def scoped(step: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """``step``, which returns a table that ``checkpointed`` wrote, with the other tables that it wrote deleted at its end.

    Every use of them is done by then, as the result is read from its own files.
    """

    @wraps(step)
    def run(*args, **kwargs) -> DataFrame:
        outer, own = _written.get(), []
        token = _written.set(own)
        try:
            out = step(*args, **kwargs)
        finally:
            _written.reset(token)
        kept = _path_of.get(id(out))
        tidied(out)
        for path in own:
            if path == kept:
                if outer is not None:
                    outer.append(path)
            elif kept is not None:
                _delete(path)
            elif outer is not None:  # the result may read any of them
                outer.append(path)
        return out

    return run


def tidied(df: DataFrame) -> None:
    """Have the driver's two processes collect their garbage: plans and broadcasts of many small steps stay there else.

    Spark's cleaner removes what belongs to them on the way.
    """
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    trim()


#: Tables written in the step that runs; the table that a DataFrame reads, as long as it lives.
_written: ContextVar[list[str] | None] = ContextVar("written", default=None)
_path_of: dict[int, str] = {}


def _delete(path: str) -> None:
    """Delete a table's folder, where the driver knows its kind of store; else it stays until the checkpoint folder goes."""
    try:
        store, place = fs.FileSystem.from_uri(re.sub("^file:/+", "/", path))
        store.delete_dir(place)
    except (OSError, pa.ArrowInvalid, pa.ArrowNotImplementedError):
        return


def row_keys(df: DataFrame) -> list[Column]:
    """Two 64-bit hashes that tell the rows (doc_id, text) of ``df`` apart."""
    row = [F.col("doc_id").cast("long"), F.col("text").cast("string")]
    return [F.xxhash64(F.lit(1), *row), F.xxhash64(*row, F.lit(2))]


def keyed_rows(docs: DataFrame, words: Column) -> tuple[DataFrame, list[str]]:
    """(docs with two key columns, their names): rows equal in doc_id and text, if they hold ``words``, are reduced to one.

    Which one isn't defined where other columns differ.  Copies are counted first; without any,
    rows pass as they are.
    """
    names = []
    for name, key in zip(("key1", "key2"), row_keys(docs), strict=True):
        docs = docs.withColumn(free_name(docs, name), key)
        names.append(docs.columns[-1])
    copies = [free_name(docs, "copies1"), free_name(docs, "copies2")]
    counted = docs.where(words).groupBy(*[F.col(n).alias(c) for n, c in zip(names, copies, strict=True)]).agg(F.count(F.lit(1)).alias("n"))
    repeated = checkpointed(counted.where("n > 1").select(*copies))
    n = repeated.count()
    if not n:
        return docs, names
    side = F.broadcast(repeated) if n <= BROADCAST_KEYS else repeated
    on = (F.col(names[0]) == F.col(copies[0])) & (F.col(names[1]) == F.col(copies[1]))
    once = docs.join(side, on, "left_anti")
    many = docs.where(words).join(side, on, "left_semi").groupBy(*[F.col(x).alias(c) for x, c in zip(names, copies, strict=True)]).agg(F.first(F.struct(*docs.columns)).alias("row"))
    blank = docs.where(~F.coalesce(words, F.lit(False))).join(side, on, "left_semi")
    return once.unionByName(blank).unionByName(many.select("row.*")), names


def without(docs: DataFrame, names: list[str], gone: DataFrame) -> DataFrame:
    """``docs`` less the rows with a key in ``gone`` (row1, row2), and without the key columns."""
    a, b = free_name(docs, "gone1"), free_name(docs, "gone2")
    gone = gone.select(F.col("row1").alias(a), F.col("row2").alias(b)).distinct()
    return docs.join(gone, (F.col(names[0]) == F.col(a)) & (F.col(names[1]) == F.col(b)), "left_anti").drop(*names)


def kept_rows(docs: DataFrame, judge: Callable[[], Callable[[pa.RecordBatch], pa.Array]]) -> DataFrame:
    """The rows of ``docs``, columns and all, of which a task's judge says true: each row is judged where it is read.

    ``judge`` is called once for each task, and what it made goes when the task ends.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = judge()
        for batch in batches:
            yield batch.filter(keep(batch))

    return _mapped(docs, run, docs.schema, judge.__module__)


def apart(df: DataFrame, torn: list[DataFrame]) -> DataFrame:
    """``df`` (id, check, ...) with new ids for those that stand for several checks (``torn``: tables of such ids)."""
    for ids in torn:
        df = df.join(F.broadcast(ids.select(F.col("id").alias("torn_"))), F.col("id") == F.col("torn_"), "left")
        df = df.withColumn("id", F.when(F.col("torn_").isNull(), F.col("id")).otherwise(F.xxhash64("id", "check"))).drop("torn_")
    return df


def distinct_nodes(signed: DataFrame, *facts: Column) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """(signed, one row for each id with ``facts``, tables of ids that were told apart).

    signed: id and check, two independent 64-bit hashes of one thing.  Things that share an id by
    chance have other checks: they get ids of their own, so that nothing is merged by 64 bits alone.
    """
    torn: list[DataFrame] = []
    while True:
        nodes = checkpointed(signed.groupBy("id").agg(F.min("check").alias("least"), F.max("check").alias("most"), *facts))
        found = checkpointed(nodes.where("least <> most").select("id"))
        if found.isEmpty():
            return signed, nodes.drop("least", "most"), torn
        torn.append(found)
        signed = checkpointed(apart(signed, [found]))


def semi_join(df: DataFrame, keys: DataFrame, on: Column, n_keys: int) -> DataFrame:
    """Rows of ``df`` with a partner in ``keys`` (``n_keys`` rows, counted by the caller).

    Up to ``BROADCAST_KEYS`` the keys go to every executor; beyond that both
    sides are shuffled.
    """
    return df.join(F.broadcast(keys) if n_keys <= BROADCAST_KEYS else keys, on, "left_semi")
