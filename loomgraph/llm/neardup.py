"""Near-duplicate classes of shingle sets: banded MinHash candidates, exact confirmation.

The engine works on *nodes*: one row for each distinct set, with the keys of its MinHash bands.
No step emits all pairs of a group:

1. each bucket (nodes with an equal band key) proposes its members' links to one hub;
2. proposals that lengths or sketches rule out are dropped, the rest is confirmed on whole sets;
3. a bucket of bounded size that still holds several components is joined within one task, which
   returns no more links than join them; of buckets with the same members one is;
4. larger buckets propose other hubs, in a few rounds, and what then still is mixed
   is joined exactly: shingles are ordered by rarity, and only sets of different components and
   compatible sizes that share one of their rarest shingles, at positions that still allow the
   threshold, are confirmed; hot shingles take hub rounds first and are then dealt into parts.

Links between different sets are thus lost only where the bands miss them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing
from .cluster import BROADCAST_KEYS, checkpointed, map_arrow, scoped, tidied
from .components import connected_components, extended

#: Nodes and characters of a bucket that is joined within a task.
GROUP_NODES, GROUP_CHARS = 2_048, 4_000_000
#: Characters of small groups that are joined at once; nodes of a group whose pairs are listed.
GROUPED_CHARS, PAIRED = 1 << 20, 12
#: Hub rounds over larger buckets before the exact join of what is left, and over its hot shingles: those of more than HOT sets.
HUB_ROUNDS, HOT_ROUNDS, HOT = 2, 3, 1_000
#: Slots (a power of two) in which shingles are counted for the exact join, and the parts that travel.
SLOT_BITS, PARTS = 22, 64


@dataclass(frozen=True)
class Similarity:
    """Jaccard similarity of at least ``num / den`` of the sets that ``sets`` gives (as of ``hashing.distinct_sets``)."""

    sets: Callable[[list], tuple[np.ndarray, np.ndarray]]
    num: int = 8
    den: int = 10
    sketch_words: int = 0
    sketch_samples: int = 0
    #: The nodes' n is the size of the set (else a size with repeats, which rules nothing out).
    sized: bool = True


def _by_size(s: Similarity, n: str, m: str) -> F.Column:
    """Sets of n and m shingles can reach the threshold."""
    return (F.least(n, m) * s.den >= F.greatest(n, m) * s.num)


def _by_sketch(s: Similarity, a: str, b: str):
    """The odd sketches don't rule the threshold out (six standard deviations are granted).

    XOR of two parity bitmaps of w bits has z ones; the samples then differ in about
    -w / 2 * ln(1 - 2 z / w) places.  At the threshold a share 1 - J of the bins that either set
    fills differs, and each such bin flips at most two bits.
    """
    if not s.sketch_words:
        return F.lit(True)
    w = 64.0 * s.sketch_words
    z = sum((F.bit_count(F.col(f"{a}s{i}").bitwiseXOR(F.col(f"{b}s{i}"))) for i in range(s.sketch_words)), F.lit(0))
    j = s.num / s.den
    bins = F.least(F.lit(float(s.sketch_samples)), F.greatest(F.col(f"{a}filled"), F.col(f"{b}filled")) / F.lit(j))
    most = 2 * (1 - j) * bins
    spread = F.sqrt(4 * j * (1 - j) * bins + (w / 4) * (F.exp(4 * most / w) - 1) + 1)
    return F.when(2 * z >= 0.98 * w, False).otherwise(-w / 2 * F.log(1 - 2 * z / w) <= most + 6 * spread)


def _near(s: Similarity, values: np.ndarray, bounds: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the sets a[i] and b[i] reach the threshold; empty ones never do."""
    sizes = np.diff(bounds)
    small, large = np.minimum(sizes[a], sizes[b]), np.maximum(sizes[a], sizes[b])
    out = (small > 0) & (s.den * small >= s.num * large)
    at = np.flatnonzero(out)
    both = hashing.shared_values(values, bounds, a[at], b[at])
    out[at] = s.den * both >= s.num * (small[at] + large[at] - both)
    return out


def _confirmed(s: Similarity):
    """mapInArrow function: (a, b, text_a, text_b) to the pairs whose whole sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, where = [], {}
            sides = []
            for side in ("a", "b"):
                at = []
                for key, text in zip(batch.column(side).to_pylist(), batch.column(f"text_{side}").to_pylist(), strict=True):
                    if key not in where:
                        where[key] = len(texts)
                        texts.append(text)
                    at.append(where[key])
                sides.append(at)
            near = _near(s, *s.sets(texts), *(np.array(side, dtype=np.int64) for side in sides))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(near))

    return run


def _spanning(ids: list[int], labels: list[int], near: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of the near pairs (i, j) as many as join the labels."""
    root = {label: label for label in labels}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for i, j in near:
        a, b = find(labels[i]), find(labels[j])
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((ids[i], ids[j]))
    return out


def _near_in(values: np.ndarray, bounds: np.ndarray, s: Similarity) -> tuple[np.ndarray, np.ndarray]:
    """All near pairs (i, j) of a bounded group's sets, by products of blocks of their incidence matrix."""
    m, sizes = len(bounds) - 1, np.diff(bounds)
    owner = np.repeat(np.arange(m), sizes)
    _, token, often = np.unique(values, return_inverse=True, return_counts=True)
    shared = often[token] > 1
    owner, token = owner[shared], token[shared]
    order = np.argsort(token, kind="stable")
    owner, token = owner[order], token[order]
    token = np.cumsum(np.concatenate([[False], token[1:] != token[:-1]])) if len(token) else token
    both = np.zeros((m, m), dtype=np.float32)
    distinct = int(token[-1]) + 1 if len(token) else 0
    width, at = min(distinct, max(1, (1 << 21) // m)), 0
    for first in range(0, distinct, max(1, width)):  # a block of shingles at a time
        end = int(np.searchsorted(token, first + width))
        block = np.zeros((m, width), dtype=np.float32)
        block[owner[at:end], token[at:end] - first] = 1
        both += block @ block.T
        at = end
    near = s.den * both.astype(np.int64) >= s.num * (sizes[:, None] + sizes[None, :] - both.astype(np.int64))
    near &= (sizes[:, None] > 0) & (sizes[None, :] > 0)
    return np.nonzero(np.triu(near, 1))


def _links_of(groups: list[list[tuple]], s: Similarity) -> list[tuple[int, int]]:
    """Links that join the labels of each group's rows (group, id, label, text): as many as it takes, of those that reach the threshold."""
    values, bounds = s.sets([row[3] for rows in groups for row in rows])
    first = np.cumsum([0, *map(len, groups)])
    out, a, b = [], [], []
    small = [g for g, rows in enumerate(groups) if len(rows) <= PAIRED]
    for g in small:
        labels = [row[2] for row in groups[g]]
        for i in range(len(labels)):
            for j in range(i + 1, len(labels)):
                if labels[i] != labels[j]:
                    a.append(first[g] + i)
                    b.append(first[g] + j)
    near = _near(s, values, bounds, np.array(a, dtype=np.int64), np.array(b, dtype=np.int64))
    found: dict[int, list[tuple[int, int]]] = {}
    for at in np.flatnonzero(near).tolist():
        g = int(np.searchsorted(first, a[at], "right")) - 1
        found.setdefault(g, []).append((int(a[at] - first[g]), int(b[at] - first[g])))
    for g, rows in enumerate(groups):
        if len(rows) > PAIRED:
            low, high = bounds[first[g]], bounds[first[g + 1]]
            found[g] = list(zip(*_near_in(values[low:high], bounds[first[g] : first[g + 1] + 1] - low, s), strict=True))
    for g, pairs in found.items():
        out += _spanning([row[1] for row in groups[g]], [row[2] for row in groups[g]], pairs)
    return out


def _joined(s: Similarity):
    """mapInArrow function: (group, id, label, text), sorted by group, to links (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, chars = [], 0
        links: list[tuple[int, int]] = []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("group", "id", "label", "text")), strict=True):
                if not groups or row[0] != groups[-1][0][0]:
                    if chars > GROUPED_CHARS:  # many small groups are joined at once
                        links += _links_of(groups, s)
                        groups, chars = [], 0
                    groups.append([])
                groups[-1].append(row)
                chars += len(row[3])
        links += _links_of(groups, s) if groups else []
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return run


def _slots(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(hashing.SHINGLE_BITS - SLOT_BITS)).astype(np.int64)


def _counted(s: Similarity):
    """mapInArrow function: texts to this task's counts of shingles by slot, as (part, counts) in PARTS parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SLOT_BITS, dtype=np.int32)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                values, _ = s.sets(batch.column("text").slice(start, 256).to_pylist())
                np.add.at(counts, _slots(values), 1)
        parts = counts.reshape(PARTS, -1)
        used = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([parts[i].tobytes() for i in used], pa.binary())], names=["part", "counts"])

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All tasks' counts of the parts that this task has."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, raw in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            counts = np.frombuffer(raw, dtype=np.int32)
            sums[part] = sums[part] + counts if part in sums else counts.copy()
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["part", "counts"])


def _prefixes(s: Similarity, often):
    """mapInArrow function: (id, label, text) to the rows (id, label, n, at, shingle) of each set's prefix.

    Shingles are ordered by rarity; the prefix is the shortest in which two sets that reach the
    threshold must share one.  Shingles that no other set can have are left out of the rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = often.value
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                ids, labels = part.column("id").to_pylist(), part.column("label").to_pylist()
                columns: list[list[np.ndarray]] = [[], [], [], [], []]
                values, bounds = s.sets(part.column("text").to_pylist())
                for i, label, low, high in zip(ids, labels, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    found, n = values[low:high], high - low
                    df = counts[_slots(found)]
                    first = np.lexsort((found, df))[: n - -(-n * s.num // s.den) + 1]
                    at = np.flatnonzero(df[first] > 1)
                    for column, x in zip(columns, (np.full(len(at), i), np.full(len(at), label), np.full(len(at), n), at + 1, found[first[at]].view(np.int64)), strict=True):
                        column.append(x.astype(np.int64))
                if columns[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], names=["id", "label", "n", "at", "shingle"])

    return run


def _prefix_rows(texts: DataFrame, s: Similarity) -> DataFrame:
    """(id, label, n, at, shingle, level) of the prefixes of sets (id, label, text).

    How often shingles occur is counted by slot, in a table of fixed size: shingles that share a
    slot only look more frequent, which changes the order and no result.  Sets that reach the
    threshold are of one level, or of neighbouring ones.
    """
    texts = checkpointed(texts)
    chars = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    texts = texts.coalesce(-(-chars // GROUP_CHARS) + 1)  # every task fills a table: no more of them than the texts need
    spread = map_arrow(texts.select("text"), _counted(s), "part int, counts binary")
    summed = map_arrow(spread.repartition(PARTS, "part"), _summed, "part int, counts binary")
    table = np.zeros((PARTS, (1 << SLOT_BITS) // PARTS), dtype=np.int32)
    for row in summed.collect():  # at most 4 << SLOT_BITS bytes
        table[row["part"]] = np.frombuffer(row["counts"], dtype=np.int32)
    often = texts.sparkSession.sparkContext.broadcast(table.reshape(-1))
    rows = map_arrow(texts, _prefixes(s, often), "id long, label long, n long, at long, shingle long")
    # a hair less than the ratio, so that rounding never puts compatible sizes two levels apart
    return checkpointed(rows.withColumn("level", F.floor(F.log(F.col("n").cast("double")) / (math.log(s.den / s.num) * (1 + 1e-9)))))


def _hot(prefix: DataFrame, turn: int) -> DataFrame:
    """(shingle_, level_, size, hub) of the prefix shingles of more than HOT sets of one level with several labels."""
    hub = F.min(F.struct(F.xxhash64("id", F.lit(turn)).alias("h"), F.col("id").alias("id"), F.col("label").alias("label"))).alias("hub")
    found = prefix.groupBy(F.col("shingle").alias("shingle_"), F.col("level").alias("level_")).agg(F.count(F.lit(1)).alias("size"), F.min("label").alias("l0"), F.max("label").alias("l1"), hub)
    return checkpointed(found.where(f"size > {HOT} and l0 < l1").select("shingle_", "level_", "size", "hub"))


def _prefix_pairs(prefix: DataFrame, hot: DataFrame, s: Similarity) -> DataFrame:
    """(a, b) of different labels that may reach the threshold: sets that share a prefix shingle at positions that still allow it.

    Only sets of one level or neighbouring ones meet.  A shingle of more than HOT sets of a level
    is dealt into parts of about HOT of them: each of the others meets every part in another task.
    """
    parts = hot.select("shingle_", "level_", F.ceil(F.col("size") / HOT).cast("int").alias("parts"))
    side = F.broadcast(parts) if parts.count() <= BROADCAST_KEYS else parts
    on = lambda level: (F.col("shingle") == F.col("shingle_")) & (level == F.col("level_"))
    a = prefix.join(side, on(F.col("level")), "left").withColumn("part", F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1))))
    a = a.select(*[F.col(c).alias(f"{c}_a") for c in ("id", "label", "n", "at", "shingle", "level")], F.col("part").cast("int").alias("part_a"))
    near = prefix.withColumn("meets", F.explode(F.array("level", F.col("level") - 1)))  # a is the smaller one
    near = near.join(side, on(F.col("meets")), "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    b = near.select(*[F.col(c).alias(f"{c}_b") for c in ("id", "label", "n", "at", "shingle", "meets", "part")])
    need = F.ceil((F.col("n_a") + F.col("n_b")) * s.num / (s.num + s.den) - 1e-9)
    left = 1 + F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))
    key = (F.col("shingle_a") == F.col("shingle_b")) & (F.col("level_a") == F.col("meets_b")) & (F.col("part_a") == F.col("part_b"))
    smaller = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("id_a") < F.col("id_b")))
    found = a.join(b, key & (F.col("label_a") != F.col("label_b")) & smaller & _by_size(s, "n_a", "n_b") & (left >= need))
    return found.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).distinct()


@scoped
def near_components(nodes: DataFrame, n_bands: int, s: Similarity, texts_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(id, root) of the nodes that have links; root is the least id of the class.

    nodes: id long (one row each), n (shingles), k0.. (band keys) and, with sketches, filled and s0..
    texts_of: from the wanted ids (one column ``id``) to rows id, text.
    """
    tidied(nodes)
    bands = nodes.select("id", F.explode(F.array(*[f"k{i}" for i in range(n_bands)])).alias("band"))
    hubs = checkpointed(bands.groupBy("band").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("hub")).where("size > 1").withColumnRenamed("band", "band_"))
    shared = F.broadcast(hubs) if hubs.count() <= BROADCAST_KEYS else hubs
    members = checkpointed(bands.join(shared, F.col("band") == F.col("band_")).select("band", "id", "hub", "size"))
    texts = checkpointed(texts_of(members.select("id").distinct()))
    facts = [*(["n"] if s.sized else []), *(["filled", *[f"s{i}" for i in range(s.sketch_words)]] if s.sketch_words else [])]
    told = checkpointed(nodes.select("id", *facts).join(members.select(F.col("id").alias("id_")).distinct(), F.col("id") == F.col("id_"), "left_semi")) if facts else None

    def confirm(pairs: DataFrame) -> DataFrame:
        if told is not None:  # sizes and sketches, where there are any, rule pairs out before texts meet
            for x in "ab":
                pairs = pairs.join(told.select([F.col(c).alias(f"{x}{c}") for c in told.columns]), F.col(x) == F.col(f"{x}id")).drop(f"{x}id")
            pairs = pairs.where((_by_size(s, "an", "bn") if s.sized else F.lit(True)) & _by_sketch(s, "a", "b")).select("a", "b")
        for x in "ab":
            pairs = pairs.join(texts.select(F.col("id").alias(f"id_{x}"), F.col("text").alias(f"text_{x}")), F.col(x) == F.col(f"id_{x}")).drop(f"id_{x}")
        return checkpointed(map_arrow(pairs.select("a", "b", "text_a", "text_b"), _confirmed(s), "a long, b long"))

    def untried(pairs: DataFrame) -> DataFrame:
        known = tried.select(F.col("a").alias("a_"), F.col("b").alias("b_"))
        return checkpointed(pairs.join(known, (F.col("a") == F.col("a_")) & (F.col("b") == F.col("b_")), "left_anti"))

    def ordered(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()

    tidied(nodes)
    tried = checkpointed(ordered(members.where("id <> hub")))
    classes = connected_components(confirm(tried))

    def labelled(classes: DataFrame, of: DataFrame) -> DataFrame:
        named = of.join(classes.select(F.col("id").alias("id_"), "root"), F.col("id") == F.col("id_"), "left")
        return named.select("band", "id", F.coalesce("root", "id").alias("label"))

    # buckets that hold several components, with what tells their sets of members and their size
    named = checkpointed(labelled(classes, members.where("size > 2")))
    lengths = texts.select(F.col("id").alias("id_"), F.length("text").alias("chars"))
    marks = [F.min("label").alias("l0"), F.max("label").alias("l1"), F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("mark")]
    mixed = named.join(lengths, F.col("id") == F.col("id_")).groupBy("band").agg(*marks).where("l0 < l1")
    mixed = checkpointed(mixed.select("band", "n", "mark", ((F.col("n") <= GROUP_NODES) & (F.col("chars") <= GROUP_CHARS)).alias("small")))
    if mixed.isEmpty():
        return classes
    once = mixed.where("small").groupBy("n", "mark").agg(F.min("band").alias("band_"))
    small = named.join(once.select("band_"), F.col("band") == F.col("band_")).select("band", "id", "label")
    small = small.join(texts.withColumnRenamed("id", "id_"), F.col("id") == F.col("id_")).select(F.col("band").alias("group"), "id", "label", "text")
    small = small.repartition("group").sortWithinPartitions("group", "id")
    classes = extended(classes, checkpointed(map_arrow(small, _joined(s), "a long, b long")))
    large = mixed.where("not small").select(F.col("band").alias("band_"))
    members = checkpointed(members.join(large, F.col("band") == F.col("band_"), "left_semi"))
    if members.isEmpty():
        return classes
    for turn in range(HUB_ROUNDS + 1):
        now = labelled(classes, members)
        hub = F.min(F.struct(F.xxhash64("id", F.lit(turn)).alias("h"), F.col("id").alias("id"), F.col("label").alias("label"))).alias("hub")
        still = now.groupBy("band").agg(F.min("label").alias("l0"), F.max("label").alias("l1"), hub).where("l0 < l1").withColumnRenamed("band", "band_")
        rest = now.join(still, F.col("band") == F.col("band_"))
        if turn == HUB_ROUNDS:
            break
        new = untried(ordered(rest.where("label <> hub.label").select("id", F.col("hub.id").alias("hub"))))
        classes, tried = extended(classes, confirm(new)), tried.unionByName(new)
    ids = checkpointed(rest.groupBy("id").agg(F.min("label").alias("label")))
    if ids.isEmpty():
        return classes
    prefix = _prefix_rows(ids.join(texts.withColumnRenamed("id", "id_"), F.col("id") == F.col("id_")).select("id", "label", "text"), s)
    for turn in range(HOT_ROUNDS):  # sets that share a hot shingle propose a hub first, which contracts most of them
        hot = _hot(prefix, turn)
        if hot.isEmpty():
            break
        met = prefix.join(F.broadcast(hot) if hot.count() <= BROADCAST_KEYS else hot, (F.col("shingle") == F.col("shingle_")) & (F.col("level") == F.col("level_")))
        new = untried(ordered(met.where("label <> hub.label").select("id", F.col("hub.id").alias("hub"))))
        links = confirm(new)
        tried = tried.unionByName(new)
        if links.isEmpty():
            break
        classes = extended(classes, links)
        labels = classes.select(F.col("id").alias("id_"), "root")
        prefix = checkpointed(prefix.drop("label").join(labels, F.col("id") == F.col("id_"), "left").select("id", F.coalesce("root", "id").alias("label"), "n", "at", "shingle", "level"))
    return extended(classes, confirm(untried(_prefix_pairs(prefix, _hot(prefix, 0), s))))
