"""Every registered query against its SQL, on the smallest tables."""

from __future__ import annotations

import os

import pytest

from palimpsest import queries as registered

registered_names: list[str] = []
duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def con(tiny):
    c = duckdb.connect()
    for name in os.listdir(tiny):
        if name.endswith(".parquet"):
            c.sql(f"create view {name[:-8]} as select * from '{tiny}/{name}'")
    return c


registered.load()


@pytest.mark.parametrize("name", sorted(registered.QUERIES))
def test_query(spark, tiny, con, name):
    got = registered.QUERIES[name](spark, tiny)
    rows = got.collect()
    if name not in registered.ORACLES:
        assert rows
        return
    want = con.sql(registered.ORACLES[name])
    order = sorted(want.columns)
    assert sorted(got.columns) == order
    expected = sorted(repr(tuple(r[want.columns.index(c)] for c in order)) for r in want.fetchall())
    assert sorted(repr(tuple(r[c] for c in order)) for r in rows) == expected


def test_entry_has_rows_without_the_optional_modules(spark, tiny, monkeypatch):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    monkeypatch.setattr(entry, "OPTIONAL", ("palimpsest.not_there",))
    assert set(entry.queries()) == set(registered.QUERIES)
    assert set(entry.oracle_sql()) == set(registered.ORACLES)


def test_nothing_imports_the_optional_folder():
    import re
    from pathlib import Path

    root = Path(registered.__file__).parent.parent
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert not re.search(r"^\s*(from|import) palimpsest\.llm", p.read_text(), re.M), p


def test_pushdown_and_pruning(spark, tiny):
    plan = registered.QUERIES["find_by_fk"](spark, tiny)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_custkey,4)" in plan
    assert "o_totalprice" not in plan.split("ReadSchema:")[1].split("\n")[0]
