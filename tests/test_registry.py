"""Queries of the library itself against their SQL on the smallest tables."""

import json
import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from heliograph.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql(sf):
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return connection


def plain(df):
    df = df[sorted(df.columns)]
    return sorted(str([None if pd.isna(x) else round(float(x), 5) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x) for x in row]) for row in df.astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("key", sorted(registry.SQL))
def test_query(spark, sf, sql, key):
    assert plain(registry.QUERIES[key](spark, sf).toPandas()) == plain(sql.sql(registry.SQL[key]).df())


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(registry.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
    assert os.path.exists(entry.__file__)


@pytest.mark.parametrize("gone", [["heliograph/llm", "tests/llm"], ["heliograph/llm", "tests/llm", "corpus_pipeline.py"], ["corpus_pipeline.py"]])
def test_entry_points_without_optional_parts(tmp_path, gone):
    root, copy = Path(__file__).resolve().parents[1], tmp_path / "copy"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse"))
    for name in gone:
        shutil.rmtree(copy / name) if (copy / name).is_dir() else (copy / name).unlink(missing_ok=True)
    code = "import json, __spark_entry__ as e; print(json.dumps([sorted(e.queries()), sorted(e.oracle_sql())]))"
    out = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    names, sql = json.loads(out.stdout.splitlines()[-1])
    assert set(registry.QUERIES) <= set(names) and set(registry.SQL) <= set(sql) and "pipeline" not in names
