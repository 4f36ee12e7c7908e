"""Line dedup, MinHash near-dedup and connected components against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest
from helpers import components, lines, shingles
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomgraph.llm import hashing, line_dedup, minhash_dedup, neardup
from loomgraph.llm.components import connected_components
from loomgraph.llm.line_dedup import BANDS, ROWS, WIDTH, duplicate_lines, without_duplicate_lines
from loomgraph.llm.minhash_dedup import near_duplicate_documents, without_near_duplicates

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n)]


def corpus(seed=3):
    """Groups of copies at all similarities, a chain, a shared passage, odd texts."""
    rng = random.Random(seed)
    texts = [None, "", " \n\t ", "one", "One", "one two", "a b c d e", "a b c d e f"]
    for _ in range(12):
        base = words(rng, rng.randint(5, 120))
        texts.append(" ".join(base))
        for _ in range(rng.randint(1, 12)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 12))):
                copy[rng.randrange(len(copy))] = rng.choice(words(rng, 3))
            texts.append(" ".join(copy).upper() if rng.random() < 0.2 else "\n".join(copy))
    chain = words(rng, 60)
    for i in range(30):  # neighbours are alike, the ends are not
        texts.append(" ".join(chain))
        chain[(i * 7) % 60] = f"new{i}"
    passage = words(rng, 50)
    texts += [" ".join(passage + words(rng, 45)) for _ in range(40)]
    return list(enumerate(texts, start=10))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", 0) for i, t in rows], DOCS)


@pytest.mark.parametrize(("width", "in_task", "hot"), [(2, 512, 1000), (5, 512, 1000), (2, 0, 1000), (2, 0, 3)])
def test_documents(spark, monkeypatch, width, in_task, hot):
    monkeypatch.setattr(neardup, "GROUP_NODES", in_task)  # 0: every bucket goes the way of large ones
    monkeypatch.setattr(neardup, "HOT", hot)  # 3: most shared shingles are dealt into parts
    rows = corpus()
    sets = {i: shingles(t, width) for i, t in rows}
    want = components(sets)
    got = {r["doc_id"]: r for r in near_duplicate_documents(frame(spark, rows), shingle_words=width).collect()}
    assert len(got) == len(rows)
    for i, _ in rows:
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (len(sets[i]), want[i], want[i] == i)


def test_hostile_documents(spark):
    """Nulls in any column, a very long text, repeated rows, clashing names."""
    long = " ".join(f"w{i}" for i in range(120_000))
    rows = [(1, long, "id"), (2, long + " end", None), (2, long + " end", None), (None, long, "q"), (3, None, "q"), (4, "", "q"), (5, "lone words here", "q")]
    docs = spark.createDataFrame([(i, t, x, x, 7, x) for i, t, x in rows], "doc_id long, text string, gone string, root string, n long, component_id string")
    got = sorted((tuple(r) for r in near_duplicate_documents(docs, shingle_words=5).collect()), key=str)
    assert got == sorted([(1, 119996, 1, True, True), (2, 119997, 1, False, False), (2, 119997, 1, False, False), (None, 119996, None, True, False), (3, 0, 3, True, True), (4, 0, 4, True, True), (5, 1, 5, True, True)], key=str)
    kept = without_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 4, 5]


def test_sets_of_one_hash_are_told_apart(spark, monkeypatch):
    """With a first key that only takes five values, the second one keeps different texts apart."""
    made = hashing.set_keys
    monkeypatch.setattr(hashing, "set_keys", lambda flat, bounds, seed=0: made(flat, bounds, seed) % np.uint64(5) if seed == minhash_dedup.KEY_SEEDS[0] else made(flat, bounds, seed))
    rows = corpus(4)[:60]
    docs = frame(spark, rows)

    def local(df, run, schema):  # in this process, where the weak key is
        batches = [pa.RecordBatch.from_arrays([pa.array([r[c] for r in df.collect()], pa.int64() if c == "doc_id" else pa.string()) for c in df.columns], names=df.columns)]
        return spark.createDataFrame(pa.Table.from_batches(list(run(iter(batches)))).to_pylist(), schema)

    monkeypatch.setattr(minhash_dedup, "map_arrow", local)
    want = components({i: shingles(t, 2) for i, t in rows})
    got = {r["doc_id"]: r["component_id"] for r in near_duplicate_documents(docs, shingle_words=2).collect()}
    assert got == {i: want[i] for i, _ in rows}


def test_lines_of_one_hash_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "text_hash", lambda text: F.xxhash64(text) % 5)
    rows = line_corpus(6)[:40]
    want = components(lines(rows, 1, WIDTH))
    got = {(r["doc_id"], r["line_no"]): (r["first_doc_id"], r["first_line_no"]) for r in duplicate_lines(frame(spark, rows)).collect()}
    assert all(want[got[key]] == want[key] for key in want)
    assert sum(got[key] != want[key] for key in want) <= len(want) * 0.02


def test_rows_of_one_doc_id_are_told_apart(spark):
    """Rows with another text and the same doc_id, or none, keep what is theirs; of rows alike one stays."""
    line, other = "a line of some length that occurs in several rows", "a line of its own which no other row has at all"
    third = "nothing but words that stand in no second place\n"
    rows = [(1, line), (2, f"{line}\nsecond line of the document"), (2, f"{other}\n{line}"), (2, third), (2, third), (None, "the only text of a row without any id"), (None, line), (3, None), (3, None), (3, " ")]
    docs = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], "doc_id long, text string, row1 int, key1 int, n int")
    got = without_duplicate_lines(docs)
    assert got.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted([(1, line), (2, "second line of the document"), (2, other), (2, third), (None, rows[5][1]), (3, None), (3, None), (3, " ")], key=str)
    text = "seven words make a text of this kind here "
    rows = [(1, text * 9), (1, text * 9), (1, "quite another text of the same id, to be kept"), (2, text * 9 + "end"), (None, text * 9), (None, "a lonely text without any doc_id at all")]
    kept = without_near_duplicates(spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, row2 int, gone1 int"))
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept.collect()) == sorted([(1, text * 9), (1, rows[2][1]), (0, rows[5][1])])


def test_all_true_links_of_documents_are_found(spark):
    """Recall of links at 0.8 or more on the smallest table, for the pipeline's five words and the query's two."""
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    for width in (2, 5):
        want = components({i: shingles(t, width) for i, t in rows})
        got = {r["doc_id"]: r["component_id"] for r in near_duplicate_documents(frame(spark, rows), shingle_words=width).collect()}
        linked = [i for i in want if want[i] != i]
        assert sum(got[i] == want[i] for i in linked) >= 0.99 * len(linked)


def test_empty_documents(spark):
    none = frame(spark, []).limit(0)
    assert near_duplicate_documents(none).count() == 0
    assert without_near_duplicates(none).count() == 0
    assert duplicate_lines(none).count() == 0
    assert without_duplicate_lines(none).count() == 0


def line_corpus(seed=5):
    rng = random.Random(seed)
    bases = [" ".join(words(rng, rng.randint(8, 40))) for _ in range(15)]
    rows = []
    for i in range(60):
        made = []
        for _ in range(rng.randint(0, 6)):
            line = rng.choice(bases) if rng.random() < 0.5 else " ".join(words(rng, 12))
            if rng.random() < 0.5:
                at = rng.randrange(len(line))
                line = line[:at] + rng.choice("xyz") + line[at + 1 :]
            made.append(rng.choice(["", "  ", "\t"]) + (line.upper() if rng.random() < 0.2 else line))
        rows.append((i, "\n".join([*made, "", "short"])))
    return [*rows, (100, None), (101, ""), (102, "\n\n")]


@pytest.mark.parametrize("in_task", [512, 0])
def test_lines(spark, monkeypatch, in_task):
    monkeypatch.setattr(neardup, "GROUP_NODES", in_task)
    rows = line_corpus()
    compared = lines(rows, 1, WIDTH)
    want = components(compared)
    got = {(r["doc_id"], r["line_no"]): ((r["first_doc_id"], r["first_line_no"]), r["kept"]) for r in duplicate_lines(frame(spark, rows)).collect()}
    assert len(got) == sum(len(t.split("\n")) for _, t in rows if t is not None)
    missed = 0
    for key, (first, kept) in got.items():
        assert kept == (first == key)
        if key not in compared:
            assert first == key
        elif first != want[key]:
            missed += 1
            assert want[first] == want[key]  # a band may miss a link, but none is made up
    assert missed <= len(compared) * 0.02
    by_set = {}
    for key, found in compared.items():
        by_set.setdefault(found, set()).add(got[key][0])
    assert all(len(firsts) == 1 for firsts in by_set.values())  # equal lines of any length are one


def test_short_lines_are_linked(spark):
    rows = [(1, "Short.\nand ornd."), (2, "short.\n\nother"), (3, " and ornd. \nshort"), (4, "  \n\n"), (5, "abcdefghijk"), (6, "ABCDEFGHIJK\nabcdefghxyz")]
    compared = lines(rows, 1, WIDTH)
    want = components(compared)
    got = {(r["doc_id"], r["line_no"]): ((r["first_doc_id"], r["first_line_no"]), r["kept"]) for r in duplicate_lines(frame(spark, rows)).collect()}
    assert got == {key: (want.get(key, key), want.get(key, key) == key) for key in got}
    assert got[2, 0] == ((1, 0), False)
    assert got[3, 0] == ((1, 1), False)
    assert all(kept for key, (_, kept) in got.items() if key not in compared)


@pytest.mark.parametrize(("size", "most"), [(22, 0.01), (30, 0.01), (40, 0.006), (60, 0.004)])
def test_bands_of_lines_miss_few(size, most):
    """Pairs at 0.8 or a little more: no band is shared by at most the share that the README names, with some room."""
    rng = random.Random(1)
    left = ["".join(rng.choice("abcdefghijklmnop") for _ in range(size + WIDTH - 1)) for _ in range(4000)]
    right = [t + "".join(rng.choice("xyz") for _ in range(size // 4)) for t in left]
    keys = []
    for texts in (left, right):
        made = [hashing.one_permutation(flat, bounds, ROWS * BANDS) for _, _, flat, bounds in hashing.char_windows(texts, WIDTH)]
        keys.append(np.vstack([hashing.band_keys(hashing.densified(*m), ROWS) for m in made]))
    assert 1 - (keys[0] == keys[1]).any(axis=1).mean() <= most


def test_lines_are_removed(spark):
    line = "the very same line of some fifty characters or so"
    rows = [(1, f"{line}\nown line of document one, long enough"), (2, f"{line.upper()}\nshort"), (3, f"  {line}\n"), (4, "clean and unique text\n\nof two lines"), (5, None), (6, ""), (None, line)]
    docs = frame(spark, rows).selectExpr("*", "1 as of", "2 as lost", "3 as id", "4 as line_no")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in without_duplicate_lines(docs).collect()}
    assert got[1][0] == rows[0][1]
    assert got[2] == ("short", 5)
    assert 3 not in got  # nothing but a copy
    assert got[4][0] == rows[3][1]
    assert got[5][0] is None
    assert got[6][0] == ""
    assert None not in got  # lines without doc_id come last
    assert without_duplicate_lines(docs).columns == docs.columns


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), max_size=40))
def test_components(spark, edges):
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        p, q = sorted((find(a), find(b)))
        root[q] = p
    linked = {x for a, b in edges if a != b for x in (a, b)}
    got = connected_components(spark.createDataFrame(edges, "a long, b long")) if edges else None
    if got is not None:
        assert {r["id"]: r["root"] for r in got.collect()} == {x: find(x) for x in linked}


def test_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long")
    assert {r["root"] for r in connected_components(edges).collect()} == {0}


def test_shingles_are_sets_of_words():
    texts = ["A b\tc", "a b c", "", None, "a", "é à", "a b a b a b", "x" * 10_000]
    for width in (1, 2, 5):
        made = list(hashing.word_shingles(texts, width))
        assert [len(x) for x in made] == [len(shingles(t, width)) for t in texts]
        assert np.array_equal(made[0], made[1])


def test_odd_sketch_estimates_difference():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 2**63, 4000).astype(np.uint64))
    b = np.sort(np.concatenate([a[:3600], np.unique(rng.integers(0, 2**63, 400).astype(np.uint64))]))
    flat, bounds = np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)])
    values, filled = hashing.one_permutation(flat, bounds, 512)
    sketch = hashing.odd_sketches(values, filled, 1024)
    z = int(np.unpackbits((sketch[0] ^ sketch[1]).view(np.uint8)).sum())
    estimate = -512 * np.log(1 - 2 * z / 1024)
    true = 2 * int((values[0] != values[1]).sum())
    assert abs(estimate - true) < 90
    minima = hashing.minimum_hashes(flat, bounds, 400)
    assert abs((minima[0] == minima[1]).mean() - 3600 / 4400) < 0.08
