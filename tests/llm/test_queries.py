"""The registered queries of the operators: all are there, and those with SQL agree with it."""

from pathlib import Path

import duckdb
import pytest

from loomwright.llm import queries


def test_registered():
    import __spark_entry__ as e

    names = [n.split("_")[0] for n in e.queries() if n.startswith("op")]
    assert sorted(names) == sorted(f"op{i}" for i in range(1, 14)) and "pipeline" in e.queries()
    assert set(queries.SQL) <= set(e.oracle_sql())


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(name, spark, sf_dir):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = queries.QUERIES[name](spark, sf_dir)
    told = con.execute(queries.SQL[name])
    assert df.columns == [d[0] for d in told.description]
    assert sorted(map(tuple, df.collect())) == sorted(told.fetchall())
