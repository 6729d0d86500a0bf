import re

import pytest
from parity import connect, duck_rows, kinds, spark_rows

import __spark_entry__ as entry
from fidelis.plans.catalog import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_rows_equal_the_oracles(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = spark_rows(df)
    if name not in ORACLE_SQL:
        assert got[1]
        return
    assert got == duck_rows(duck, ORACLE_SQL[name])
    assert not kinds(df, duck, ORACLE_SQL[name])


def test_entry_counts(spark):
    counts = {r.res: r.n for r in entry.entry(spark).collect()}
    assert counts == {"E1": 111, "E2": 84, "E3": 29, "E4": 551, "E5": 138, "E6": 447, "S1": 57, "S2": 43, "S3": 40}


def test_every_query_is_listed():
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE_SQL) <= set(entry.oracle_sql()) <= set(entry.queries())


def test_the_rest_stands_without_the_training_data_operators(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(entry.__file__).parent
    shutil.copytree(root / "fidelis", tmp_path / "fidelis", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()))"], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=120)
    assert said.stdout.strip() == str(len(QUERIES)), said.stderr


def test_filters_and_columns_reach_the_scan(spark):
    from fidelis.operators import images

    rows = spark.read.parquet(f"{SF}/documents.parquet").where("n_chars >= 200").select("doc_id", "lang")
    plan = images.call_model(rows, lambda: lambda frame: frame, "doc_id long, lang string")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(n_chars,200)" in plan and not re.search(r"ReadSchema: struct<[^>]*text", plan)
    assert not re.search(r"ReadSchema: struct<[^>]*(lang|source)", QUERIES["contamination"](spark, SF)._jdf.queryExecution().executedPlan().toString())
