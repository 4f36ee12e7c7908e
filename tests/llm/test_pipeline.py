"""The corpus pipeline stage by stage, and the registered queries on the smallest data."""

import pytest
from helpers import components, contamination, lines, shingles

import __spark_entry__ as entry
import corpus_pipeline
from loomgraph.llm.line_dedup import WIDTH
from loomgraph.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """docs before the first stage and after each, written and read again."""
    top = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, out[-1], DATA).write.parquet(str(top / name))
        out.append(spark.read.parquet(str(top / name)))
    return out


def pairs(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def test_columns(stages):
    for df in stages[:-1]:
        assert df.columns == stages[0].columns


def test_language_stage_keeps_clean_documents(stages):
    assert pairs(stages[1]) == {i: t for i, t in pairs(stages[0]).items() if any(c.isalpha() for c in t or "")}


def test_line_stage(stages):
    before, after = pairs(stages[1]), pairs(stages[2])
    compared = lines(sorted(before.items()), 1, WIDTH)
    roots = components(compared)
    for i, text in before.items():
        kept = [x for n, x in enumerate(text.split("\n")) if roots.get((i, n), (i, n)) == (i, n)]
        if any(x.strip(" ") for x in kept) or text == "":
            assert after[i] == "\n".join(kept)
        else:
            assert i not in after


def test_near_duplicate_stage(stages):
    before, after = pairs(stages[2]), pairs(stages[3])
    roots = components({i: shingles(t, 5) for i, t in before.items()})
    assert set(after) == {i for i in before if roots[i] == i}


def test_decontamination_stage(spark, stages):
    before, after = pairs(stages[3]), pairs(stages[4])
    items = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()]
    found = contamination(before.items(), items)
    assert set(after) == {i for i in before if not found[i][1]}


def test_packing_stage(stages):
    got = stages[5]
    assert {r["doc_id"] for r in got.select("doc_id").distinct().collect()} == set(pairs(stages[4]))


def test_run(spark, stages):
    got = corpus_pipeline.run(spark, DATA)
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert got.groupBy("doc_id").sum("length").count() == stages[5].groupBy("doc_id").sum("length").count()
    assert got.agg({"length": "sum"}).first()[0] == stages[5].agg({"length": "sum"}).first()[0]
    assert set(columns) <= set(got.columns)


def test_registered():
    names = set(entry.queries())
    assert set(QUERIES) | {"pipeline"} <= names
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 11)}
    assert set(entry.oracle_sql()) <= names


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_runs_over_whole_table(spark, name):
    got = QUERIES[name](spark, DATA)
    if "doc_id" in got.columns and name not in ("op1_line_dedup", "op2_packing"):
        assert got.count() == spark.read.parquet(f"{DATA}/documents.parquet").count()
    else:
        assert got.count() > 0


def test_line_query_links_short_lines(spark):
    """The registered query links every copy of a line that isn't blank, however short."""
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    compared = lines(rows, 1, WIDTH)
    want = components(compared)
    got = {(r["doc_id"], r["line_no"]): (r["first_doc_id"], r["first_line_no"]) for r in QUERIES["op1_line_dedup"](spark, DATA).collect()}
    short = set(compared) - set(lines(rows, 30, WIDTH))
    assert any(want[key] != key for key in short)
    assert all(want[got[key]] == want[key] for key in compared)  # none is made up
    copies = {}
    for key in sorted(compared):
        copies.setdefault(compared[key], []).append(key)
    assert all(len({got[key] for key in keys}) == 1 for keys in copies.values())
    assert sum(got[key] != want[key] for key in short) <= len(short) * 0.02
