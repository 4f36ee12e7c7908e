"""Packing: exact round trip, little padding, every limit."""

import weakref
from collections import defaultdict

import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from loomgraph.llm import cluster, langid, packing
from loomgraph.llm.packing import Encoder, differencing, pack_block, pack_documents

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["x" * 100 + " " + "é" * 70 + " x " + "y" * 64, "a's'song we'rent ''s' '' 1's2 !'s", "it's 'S I'll o'clock ''s x_y 12³ ½ naïve ÉCOLE", "İstanbul ŉ Σίσυφος ΣΑΣ", "<|endoftext|> and <|startoftext|>", "", " ", "ﬁ 漢字 \x1c\x1f \x85 ​ a", "don't 're'VE'll'd --- ''''s", "\ttab\r\nx", "\x7f\x80 a\xa0b\x0bc", "é é"]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.characters(codec="utf-8"), max_size=60) | st.text(alphabet="ab'stREvé 1²\n.,<|>", max_size=60))
def test_ids(tokenizer, text):
    made = Encoder(PATH) if not hasattr(test_ids, "made") else test_ids.made
    test_ids.made = made
    ids = tokenizer.encode(text, add_special_tokens=False).ids
    assert made(text) == b"".join(i.to_bytes(4, "little") for i in ids)


@pytest.mark.parametrize("text", TEXTS)
def test_ids_of_odd_texts(tokenizer, text):
    assert Encoder(PATH)(text) == b"".join(i.to_bytes(4, "little") for i in tokenizer.encode(text, add_special_tokens=False).ids)


def test_round_trip(spark, tokenizer):
    long = "many different words " * 9000
    rows = [(i, f"text number {i} " * (i % 97 * 7)) for i in range(400)] + [(900, None), (901, ""), (902, long), (None, "no id"), (7, "a repeated id")]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, start long, ids long")
    found = pack_documents(docs, PATH, windows=8).collect()
    sequences, by_doc = defaultdict(list), defaultdict(list)
    for r in found:
        assert len(r["ids"]) == 4 * r["length"] > 0
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        by_doc[r["doc_id"]].append(r)
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096
    for i, t in rows:
        if i == 7:
            continue
        pieces = sorted(by_doc[i], key=lambda r: r["start"])
        ids = b"".join(bytes(r["ids"]) for r in pieces)
        want = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        assert ids == b"".join(x.to_bytes(4, "little") for x in want)
        assert {r["doc_tokens"] for r in pieces} == {len(want)}
        assert [r["start"] for r in pieces] == [sum(p["length"] for p in pieces[:k]) for k in range(len(pieces))]
    total = sum(r["length"] for r in found)
    tasks = docs.rdd.getNumPartitions()
    assert len(sequences) <= total / 4096 + tasks + 1
    assert pack_documents(docs.limit(0), PATH).count() == 0


def test_whole_documents(spark):
    docs = spark.createDataFrame([(i, "word " * (i * 13 % 900)) for i in range(200)], "doc_id long, text string").coalesce(1)
    found = pack_documents(docs, PATH, windows=4, cut=False).collect()
    assert len(found) == 200
    assert all(r["length"] == r["doc_tokens"] for r in found)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=40))
def test_block(sizes):
    windows = pack_block(sizes, 100)
    assert all(0 < sum(sizes[i] for i in w) <= 100 for w in windows)
    assert sorted(i for w in windows for i in w) == list(range(len(sizes)))


def test_the_window_count_rises_as_long_as_a_window_exceeds_the_capacity():
    assert len(pack_block([60, 60, 60], 100)) == 3  # 180 would fill two windows, but no two items share one
    assert len(pack_block([50, 50, 60], 100)) == 2
    sizes = [40] * 5 + [70] * 3
    assert max(sum(sizes[i] for i in part) for part in differencing(sizes, 5)) > 100 >= max(sum(sizes[i] for i in w) for w in pack_block(sizes, 100))


def test_windows_are_what_differencing_gives(spark):
    rows = [(i, "some words of a text " * (i * 37 % 61 + 1)) for i in range(600)]
    found = pack_documents(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), PATH, windows=16).collect()
    filled = defaultdict(int)
    for r in found:
        filled[r["sequence_id"]] += r["length"]
    sizes = sorted(filled.values())
    assert sum(sizes) > 0.99 * 4096 * (len(sizes) - 1)
    assert sum(n == 4096 for n in sizes) < len(sizes) / 2  # not filled up by cutting: a little room is left in most


def test_a_very_long_text_and_rows_alike(spark):
    rows = [(1, "word " * 400_000), (1, "word " * 400_000), (2, "x" * 300_000)]
    found = pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), PATH).collect()
    assert sum(r["length"] for r in found if r["doc_id"] == 1) == 2 * 400_001
    assert sum(r["length"] for r in found if r["doc_id"] == 2) == {r["doc_tokens"] for r in found if r["doc_id"] == 2}.pop()
    assert all(r["offset"] + r["length"] <= 4096 for r in found)


def test_differencing_is_near_equal():
    sizes = [(i * 7919) % 1000 + 1 for i in range(400)]
    sums = [sum(sizes[i] for i in part) for part in differencing(sizes, 16)]
    assert sum(sums) == sum(sizes)
    assert max(sums) - min(sums) < 120
    assert sorted(i for part in differencing([8, 7, 6, 5, 4], 2) for i in part) == [0, 1, 2, 3, 4]


@pytest.fixture
def packed(spark, monkeypatch):
    """Packing's task over given batches, run in this process."""

    class Docs:
        sparkSession = spark

        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            return run

    monkeypatch.setattr(packing.TaskContext, "get", classmethod(lambda cls: type("Of", (), {"partitionId": lambda self: 0})()))
    return lambda batches: lambda: pack_documents(Docs(), PATH)(iter(batches))


def test_a_worker_keeps_one_operators_things(spark, packed):
    """what packing holds from task to task is gone when a task of language identification begins in the same process, and not before."""

    class Frame:
        sparkSession = spark

        def mapInArrow(self, run, schema):
            return run

    list(packed([])())
    held = weakref.ref(packing.encoder(PATH))
    list(packed([])())
    assert held() is not None
    list(cluster.map_arrow(Frame(), langid._count, "")(iter([])))
    assert held() is None


def test_one_vocabulary_serves_both_tokenizers():
    """an encoder has its vocabulary once in memory; ids follow the tokenizer (test_ids)."""
    made = Encoder(PATH)
    assert made._words.model.dropout is None
    made._tokenizer.model.dropout = 0.5
    assert made._words.model.dropout == 0.5


def test_rows_are_returned_by_their_bytes(packed):
    """a task's batches hold about 1 MB of ids, however long a text is."""
    texts = ["word " * 2_000_000, "a b", None, "word " * 3_000]
    batches = list(packed([pa.RecordBatch.from_pydict({"doc_id": [1, 2, 3, 4], "text": texts})])())
    assert max(b.column("ids").nbytes for b in batches) < 2 << 20
    got = [(r["doc_id"], r["start"], r["length"], r["doc_tokens"]) for b in batches for r in b.to_pylist()]
    for doc_id, n in zip([1, 2, 3, 4], [2_000_001, 3, 1, 3_001], strict=True):
        own = sorted(x for x in got if x[0] == doc_id)
        assert [x[1] for x in own] == [sum(y[2] for y in own[:i]) for i in range(len(own))]
        assert sum(x[2] for x in own) == n == own[0][3]
