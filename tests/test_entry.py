import importlib
import os
import pathlib

import duckdb
import pytest

import __spark_entry__ as entry
from marlstone.plans import all_registries

DATA = "/root/testdata/sf0.001"
CORE = [n for r in all_registries() for n in r.sql]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for f in os.listdir(DATA):
        con.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{DATA}/{f}')")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", CORE)
def test_queries_equal_their_sql(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    want = duck.execute(entry.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(df.columns)
    tidy = lambda rows: sorted((tuple(round(x, 5) if isinstance(x, float) else tuple(x) if isinstance(x, list) else x for x in r) for r in rows), key=repr)
    assert tidy(df.select(names).collect()) == tidy(want.fetchall())


def test_nothing_else_imports_llm():
    root = pathlib.Path(entry.__file__).parent / "marlstone"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "marlstone.llm" not in p.read_text()


def test_no_positional_joins():
    root = pathlib.Path(entry.__file__).parent / "marlstone"
    for p in root.rglob("*.py"):
        text = p.read_text()
        assert "monotonically_increasing_id" not in text and "zipWithIndex" not in text and "localCheckpoint" not in text, p


def test_entry_runs(spark):
    if not os.path.isdir(DATA):
        pytest.skip("no test data")
    assert entry.entry(spark).columns == ["cluster", "rank", "term", "score"]
    importlib.reload(entry)
