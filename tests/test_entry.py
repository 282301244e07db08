"""The driver contract, with and without the training-data operators."""

import os
import re
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_contract(spark):
    q, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(q) and len(q) > 100
    df = entry.entry(spark)
    assert df.count() == 25 and "rank" in df.columns


@pytest.mark.parametrize("pipeline", [True, False])
def test_without_llm(tmp_path, pipeline):
    """With both folders gone, with and without the pipeline's file, the rest imports and answers."""
    for name in ("viewspan", "tests", "__spark_entry__.py", *["corpus_pipeline.py"] * pipeline):
        src = os.path.join(ROOT, name)
        if os.path.exists(src):
            (shutil.copytree if os.path.isdir(src) else shutil.copy)(src, tmp_path / name)
    for folder in ("viewspan/llm", "tests/llm"):
        shutil.rmtree(tmp_path / folder, ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": ""}, timeout=120)


def test_nothing_else_imports_llm():
    for folder, _, names in os.walk(os.path.join(ROOT, "viewspan")):
        if "llm" in folder:
            continue
        for n in names:
            if n.endswith(".py"):
                assert not re.search(r"\bllm\b", open(os.path.join(folder, n)).read()), n


def test_workers_import_the_package_from_anywhere(tmp_path):
    code = f"""
import sys; sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '2').getOrCreate()
import __spark_entry__ as e
assert e.queries()['eigenvalues'](s, '/root/testdata/sf0.001').count() == 10
"""
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, timeout=180)
