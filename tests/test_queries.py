"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__
from kinlake.plans.catalog import ORACLES, QUERIES

#: Queries that take long for what they add here; the larger scale runs them too.
SLOW: set[str] = set()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


def canonical(rows, columns):
    def cell(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "~"
        if isinstance(v, bool):
            return str(v)
        if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
            return f"{float(v):.5f}".replace("-0.00000", "0.00000")
        return str(v)

    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(cell(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(set(ORACLES) - SLOW))
def test_against_sql(spark, duck, sf_dir, name):
    got = QUERIES[name](spark, sf_dir)
    want = duck.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert canonical([tuple(r) for r in got.collect()], got.columns) == canonical(want.fetchall(), columns)


@pytest.mark.parametrize("name", [n for n in sorted(set(QUERIES) - set(ORACLES)) if n not in ("leiden_resolution", "block_embed_trained")])
def test_other_queries_run(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).columns


def test_entry_points(spark):
    assert __spark_entry__.entry(spark).columns == ["rid", "label"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(QUERIES) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("gone", ["corpus_pipeline", "kinlake.llm"])
def test_entry_without_the_corpus_operators(monkeypatch, gone):
    import builtins

    real = builtins.__import__

    def without(name, *args, **kwargs):
        if name == gone:
            raise ModuleNotFoundError(f"No module named '{gone}'", name=gone)
        return real(name, *args, **kwargs)

    monkeypatch.setattr(builtins, "__import__", without)
    assert set(__spark_entry__.queries()) == set(QUERIES)
