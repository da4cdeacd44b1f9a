"""Every registered query against its SQL, on DuckDB, over the same tables."""

import math
from pathlib import Path

import duckdb
import pytest

from loomwright.jobs import access, answers, datasets, extras, governance, queries, stores  # noqa: F401: registered by import
from loomwright.jobs.registry import QUERIES, SQL


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = []
    for v in values:
        r = []
        for i in order:
            x = v[i]
            r.append(float(f"{x:.6g}") if isinstance(x, float) and math.isfinite(x) else x)
        out.append(tuple(r))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(name, spark, sf_dir, duck):
    df = QUERIES[name](spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    told = duck.execute(SQL[name])
    want = rows([d[0] for d in told.description], told.fetchall())
    assert sorted(df.columns) == sorted(d[0] for d in told.description)
    assert len(got) == len(want)
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    assert not bad, bad[:3]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(name, spark, sf_dir):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_registered(spark):
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
