"""The driver contract: names, guard, and every SQL statement on the smallest tables."""

import importlib
import os
import sys

import duckdb
import pandas as pd
import pytest

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(df):
    df = df[sorted(df.columns)]
    said = lambda v: "NULL" if v is None or v is pd.NA or v != v else str(int(v)) if isinstance(v, (int, float)) and float(v).is_integer() else str(v)
    return sorted(tuple(map(said, r)) for r in df.itertuples(index=False, name=None))


def catalog():
    from tidemark.plans import catalog as c
    return sorted(c.QUERIES)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", [n for n in catalog() if not n.startswith(("i", "x"))] + ["x1_grid_step", "x6_join_count", "i3_bounded"])
def test_query_equals_sql(spark, name):
    from tidemark.plans import catalog as c
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    got, want = c.QUERIES[name](spark, SF).toPandas(), con.execute(c.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got) == normal(want)


WHOLE = ["i1_iterate", "i3_bounded", "i4_semi_naive"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", WHOLE)
def test_iteration_over_every_key(spark, name):
    from tidemark.plans import catalog as c
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    got, want = c.QUERIES[f"{name}_whole"](spark, SF).toPandas(), con.execute(c.ORACLE[f"{name}_whole"]).df()
    assert normal(got) == normal(want)
    keys = {r[0] for r in con.execute("select distinct o_custkey from orders").fetchall()}
    assert len(keys) > 60 and keys <= set(got.x)


def test_entry_without_llm(monkeypatch):
    for name in [n for n in sys.modules if n.startswith("tidemark.llm") or n in ("corpus_pipeline", "__spark_entry__")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "tidemark.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    entry = importlib.import_module("__spark_entry__")
    names = entry.queries()
    assert "x6_join_count" in names and not any(n.startswith("op") or n == "pipeline" for n in names)
    assert set(entry.oracle_sql()) <= set(names)
    monkeypatch.delitem(sys.modules, "__spark_entry__")


def test_entry_runs(spark):
    import __spark_entry__ as entry
    assert entry.entry(spark).columns == ["key", "count", "multiplicity", "version"]
