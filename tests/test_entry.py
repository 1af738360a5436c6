"""Every registered query against its SQL, and what its plan must not hold."""

import math
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from tests.helpers import DATA

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "NULL"
    if isinstance(value, float):
        return str(int(value)) if value == int(value) else repr(round(value, 6))
    return str(value)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(row[i]) for i in order) for row in data)


def test_names_match():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("gone", [["blockmill/llm", "tests/llm"], ["blockmill/llm", "tests/llm", "corpus_pipeline.py"]])
def test_the_rest_works_without_the_optional_part(tmp_path, gone):
    root = Path(entry.__file__).parent
    copy = tmp_path / "copy"
    shutil.copytree(root, copy, ignore=lambda folder, names: [
        n for n in names
        if n in (".git", "__pycache__", ".pytest_cache") or str((Path(folder) / n).relative_to(root)) in gone
    ])
    code = "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op') for n in e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, check=True).stdout
    rest = [n for n in entry.queries() if n != "pipeline" and not (n.startswith("op") and n[2].isdigit())]
    assert out.split() == [str(len(rest)), "False"]


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, duck, name):
    got = entry.queries()[name](spark, DATA)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    data = got.collect()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert data
        return
    want = duck.sql(sql)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, data) == rows(want.columns, want.fetchall())
