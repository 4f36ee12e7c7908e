"""Every registered query of the code index against its DuckDB twin, and the entry module."""

import math
import os
import shutil
import subprocess
import sys

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from loomgraph.plans.catalogue import ORACLE_SQL, QUERIES
from loomgraph.plans.views import table

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        path = os.path.join(DATA, name)
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return round(v, 6)
    return str(pd.Timestamp(v)) if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(v) for v in r) for r in df.select(*columns).collect()), key=repr)
    if name not in ORACLE_SQL:
        assert got
        return
    result = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=repr)
    assert got == want


def test_model_tables_read_every_row(spark, duck):
    """Call edges come from all line numbers, published events from the whole queue."""
    want = duck.execute("SELECT DISTINCT concat('n', l_partkey % 100), concat('n', l_suppkey) FROM lineitem").fetchall()
    assert {tuple(r) for r in table(spark, DATA, "edges").select("callee", "caller").collect()} == set(want)
    events = duck.execute("SELECT event_id FROM events").fetchall()
    assert sorted(r["id"] for r in table(spark, DATA, "published").select("id").collect()) == sorted(i for (i,) in events)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert "callee" in df.columns
    assert set(QUERIES) <= set(entry.queries())


def test_without_training_data_operators(tmp_path):
    """The entry module and the code index work when the optional subpackage and its pipeline are gone."""
    here = os.path.dirname(os.path.abspath(entry.__file__))
    shutil.copytree(os.path.join(here, "loomgraph"), tmp_path / "loomgraph", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(here, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'call_edges' in q and not any(n.startswith('op') for n in q) and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True)


def test_with_a_broken_optional_import(tmp_path):
    """The code index stays when the operators of training data lack something that they import."""
    here = os.path.dirname(os.path.abspath(entry.__file__))
    shutil.copytree(os.path.join(here, "loomgraph"), tmp_path / "loomgraph", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    (tmp_path / "loomgraph" / "llm").mkdir()
    (tmp_path / "loomgraph" / "llm" / "__init__.py").write_text("")
    (tmp_path / "loomgraph" / "llm" / "queries.py").write_text("import no_such_module\n")
    shutil.copy(os.path.join(here, "__spark_entry__.py"), tmp_path)
    subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert 'call_edges' in e.queries() and e.oracle_sql()"], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True)
