"""Every registered query runs on the small tables, and equals its SQL where it has one."""

import os

import duckdb
import pytest

from cohortcast import queries as registry

RUNS, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(RUNS))
def test_query(spark, duck, sf_dir, tmp_path, name):
    out = f"{tmp_path}/out"
    RUNS[name](spark, sf_dir).write.parquet(out)
    duck.execute(f"CREATE OR REPLACE TABLE ours AS SELECT * FROM '{out}/*.parquet'")
    if name not in SQL:
        assert duck.execute("SELECT count(*) FROM ours").fetchall()[0][0] > 0
        return
    duck.execute(f"CREATE OR REPLACE TABLE theirs AS {SQL[name]}")
    columns = sorted(r[0] for r in duck.execute("DESCRIBE theirs").fetchall())
    assert columns == sorted(r[0] for r in duck.execute("DESCRIBE ours").fetchall())
    cols = ", ".join(f'"{c}"' for c in columns)
    for a, b in (("ours", "theirs"), ("theirs", "ours")):
        assert duck.execute(f"SELECT {cols} FROM {a} EXCEPT ALL SELECT {cols} FROM {b} LIMIT 3").fetchall() == []


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns[:2] == ["card", "member"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
