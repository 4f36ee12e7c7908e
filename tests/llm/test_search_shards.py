"""Exact top-k search and sharding."""

import random

import numpy as np
import pytest

from loomgraph.llm import maxscore, sharding
from loomgraph.llm.maxscore import Postings, best_of, integer_vectors, top_inner_products
from loomgraph.llm.sharding import place, shard_documents


def brute(rows, queries, k=10):
    out = {}
    for q, v in queries.items():
        scored = sorted(((-sum(int(a) * int(b) for a, b in zip(v, w, strict=False)), i) for i, w in rows if i != q))[:k]
        out[q] = [(i, -s) for s, i in scored]
    return out


def answer(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        assert r["rank"] == len(out.setdefault(r["query_id"], [])) + 1
        out[r["query_id"]].append((r["vec_id"], r["score"]))
    return out


@pytest.mark.parametrize("size", [1, 5, 700])
def test_search(spark, monkeypatch, size):
    monkeypatch.setattr(maxscore, "PART_ROWS", 200)
    monkeypatch.setattr(maxscore, "QUERY_BYTES", 200)  # three queries of eight components
    monkeypatch.setattr(maxscore, "FIRST", 2)
    rng = np.random.default_rng(size)
    made = [(i, [float(x) for x in np.round(rng.normal(0, 0.2, 8), 2)], i % 3) for i in range(size)]
    made = [(i, v if i % 50 else [0.5] * 8, n) for i, v, n in made]  # ties
    table = spark.createDataFrame(made, "vec_id long, embedding array<float>, score int")
    vectors = integer_vectors(table)
    rows = [(r["id"], r["v"]) for r in vectors.collect()]
    assert all(w == [int(np.floor(1024 * float(np.float32(x)))) for x in v] for (_, w), (_, v, _) in zip(sorted(rows), made, strict=True))
    queries = {i: v for i, v in rows if i % 100 == 0}
    got = answer(top_inner_products(vectors, vectors.where("id % 100 = 0")))
    assert got == {q: found for q, found in brute(rows, queries).items() if found}


def test_hostile_vectors(spark):
    nan, inf = float("nan"), float("inf")
    made = [(0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, []), (6, [1.0]), (7, [-1.0, 3.0]), (None, [9.0, 9.0]), (7, [-1.0, 3.0]), (8, [1e11, -1e11])]
    vectors = integer_vectors(spark.createDataFrame(made, "vec_id long, embedding array<double>"))
    got = answer(top_inner_products(vectors, vectors.where("id = 0")))
    assert got == {0: [(7, 5 * 1024 * 1024), (7, 5 * 1024 * 1024), (6, 1024 * 1024), (5, 0), (8, -1024 * 1024 * 10**11)]}
    none = vectors.limit(0)
    assert top_inner_products(none, none).count() == 0
    assert top_inner_products(vectors, none).count() == 0


def test_pruned_search_is_exact():
    rng = np.random.default_rng(0)
    vectors = rng.integers(-50, 50, (5000, 16)) * (rng.random((5000, 16)) < 0.3)
    ids = np.arange(5000)
    postings = Postings(vectors, ids)
    for q in range(20):
        at, scores = best_of(vectors[q], q, postings, 10)
        every = vectors @ vectors[q]
        want = [i for i in np.lexsort((ids, -every)) if i != q][:10]
        assert at.tolist() == want
        assert scores.tolist() == every[want].tolist()


def test_traversal_stops_early(monkeypatch):
    """Of vectors with a few large components only the tops of the essential postings are read."""
    rng = np.random.default_rng(1)
    vectors = np.where(rng.random((4000, 12)) < 0.02, rng.integers(500, 1000, (4000, 12)), rng.integers(0, 3, (4000, 12)))
    read = []
    entries = Postings.entries
    monkeypatch.setattr(Postings, "entries", lambda self, t, up, a, b: read.append(b - a) or entries(self, t, up, a, b))
    postings = Postings(vectors, np.arange(4000))
    for q in range(0, 4000, 400):
        query = np.where(vectors[q] > 400, vectors[q], 0)
        if not query.any():
            continue
        read.clear()
        at, scores = best_of(query, q, postings, 5)
        every = vectors @ query
        assert scores.tolist() == sorted((int(x) for i, x in enumerate(every) if i != q), reverse=True)[:5]
        assert sum(read) < 4000


def test_shards(spark):
    hot = "the same text again and again " * 20
    rows = [(i, hot) for i in range(700)] + [(1000 + i, f"text {i} " * (i % 60)) for i in range(1500)] + [(5000, None), (5001, ""), (5002, "x" * 2_000), (None, "no id"), (5000, None)]
    docs = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], "doc_id long, text string, shard int, g1 int, bytes int").repartition(5)
    found = shard_documents(docs, shards=8)
    got = found.collect()
    assert len(got) == len(rows)
    by_shard = {}
    for r in got:
        by_shard.setdefault(r["shard"], []).append(r)
    assert sorted(by_shard) == list(range(8))
    for members in by_shard.values():
        assert sorted(r["slot"] for r in members) == list(range(len(members)))
    for total in ("size", "tokens"):
        sums = [sum(r[total] for r in members) for members in by_shard.values()]
        assert max(sums) - min(sums) < 0.05 * sum(sums) / 8 + 1
    counts = [len(m) for m in by_shard.values()]
    assert max(counts) - min(counts) < 0.05 * len(rows) / 8 + 1
    spread = {}
    texts = dict(rows)
    for r in got:
        if r["doc_id"] is not None:
            spread.setdefault(texts[r["doc_id"]], set()).add(r["shard"])
    assert all(len(s) == 1 for t, s in spread.items() if t != hot)  # only a group that exceeds a shard is split
    assert len(spread[hot]) > 1
    sizes = {r["doc_id"]: r["size"] for r in got}
    assert sizes[5000] == sizes[5001] == 16
    assert {r["tokens"] for r in got if r["doc_id"] == 0} == {120}
    again = {(r["doc_id"], r["shard"], r["slot"]) for r in shard_documents(docs, shards=8).collect()}
    assert again == {(r["doc_id"], r["shard"], r["slot"]) for r in got}


def test_groups_of_copies_stay_together(spark):
    """Copies of all shares of the rows up to a shard's; many size classes; groups placed in several parts of a class."""
    rng = random.Random(6)
    rows, at = [], 0
    for g in range(900):
        text = f"group {g} " * rng.choice([1, 1, 2, 5, 40, 300])
        for _ in range(rng.choice([1, 1, 1, 2, 3, 9]) if g else 60):
            rows.append((at, text))
            at += 1
    rng.shuffle(rows)
    got = shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), shards=10).collect()
    texts, spread = dict(rows), {}
    for r in got:
        spread.setdefault(texts[r["doc_id"]], set()).add(r["shard"])
    assert len(got) == len(rows)
    assert all(len(s) == 1 for s in spread.values())
    for column in ("size", "tokens"):
        sums = [sum(r[column] for r in got if r["shard"] == s) for s in range(10)]
        assert max(sums) - min(sums) < 0.05 * sum(sums) / 10


def test_size_classes_are_placed_in_parts(spark, monkeypatch):
    monkeypatch.setattr(sharding, "HEAVY", 50)
    monkeypatch.setattr(sharding, "TOGETHER", 40)
    rows = [(i, f"{i} " * (1 + 2000 // (i + 1))) for i in range(1500)]
    got = shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), shards=4).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(1500))
    for column in ("size", "tokens"):
        sums = [sum(r[column] for r in got if r["shard"] == s) for s in range(4)]
        assert max(sums) - min(sums) < 0.05 * sum(sums) / 4


def test_a_very_long_text(spark):
    rows = [(1, "x y " * 500_000), (2, "x y " * 500_000)] + [(i, f"small {i}") for i in range(3, 300)]
    got = {r["doc_id"]: r for r in shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), shards=4).collect()}
    assert len(got) == 299
    assert got[1]["size"] == 2_000_016
    assert got[1]["shard"] != got[2]["shard"]  # two copies fill two shards each: the group is split


def test_no_documents(spark):
    assert shard_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_place_follows_the_dot_product():
    rng = np.random.default_rng(4)
    items = rng.gamma(1.0, 1.0, (200, 3))
    demand = items / (items.sum(axis=0) / 5)
    left, want = np.ones((5, 3)), {}
    for i in sorted(range(200), key=lambda i: (-demand[i].max(), i)):
        fitting = [s for s in range(5) if (demand[i] <= left[s] + 1e-9).all()]
        if fitting:
            want[i] = max(fitting, key=lambda s: (float(left[s] @ demand[i]), -s))
        else:
            want[i] = min(range(5), key=lambda s: ((demand[i] - left[s]).max(), s))
        left[want[i]] -= demand[i]
    residual = np.ones((5, 3))
    assert place(demand, residual).tolist() == [want[i] for i in range(200)]
    assert np.allclose(residual, left)
    assert len(place(np.zeros((0, 3)), np.ones((4, 3)))) == 0


def test_tokens_are_words(spark):
    texts = ["", "  ", "a", " a  b\tc\nd ", "é\x0bx\x0cy\rz", None]
    got = {r["doc_id"]: r["tokens"] for r in shard_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), shards=2).collect()}
    assert [got[i] for i in range(6)] == [0, 0, 1, 4, 4, 0]
