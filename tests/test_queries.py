"""Every registered engine query against its SQL on the smallest tables."""

import os
import shutil
import subprocess
import sys

import duckdb
import pytest

from helixframe.plans.queries import ORACLE, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, small, duck, name):
    got = QUERIES[name](spark, small).toPandas()
    want = duck.execute(ORACLE[name]).fetchdf()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    rows = lambda d: sorted(map(str, d[cols].astype(object).where(d[cols].notna(), None).values.tolist()))
    assert rows(got) == rows(want)


def test_entry_without_training_operators(spark, small):
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(ORACLE) <= set(e.oracle_sql())
    assert e.entry(spark).columns == ["tile_id", "cnt"]


def test_entry_when_the_training_operators_are_gone(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/helixframe", tmp_path / "helixframe", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(sorted(e.queries()), sorted(e.oracle_sql()))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env=env, check=True)
    assert out.stdout.strip() == f"{sorted(QUERIES)} {sorted(ORACLE)}"
