"""The driver's entry points, and life without the training-data operators."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(3).count() == 3
    assert set(e.oracle_sql()) <= set(e.queries())


def test_imports_without_llm(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py", "spark-warehouse"))
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and not any(n.startswith('op1_') for n in q)"], cwd=copy, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    # the folder is there, but what it needs is not: the graph queries are left, and one runs
    shutil.copytree(os.path.join(ROOT, "graphloom", "llm"), copy / "graphloom" / "llm") if os.path.isdir(os.path.join(ROOT, "graphloom", "llm")) else None
    code = """import sys; sys.modules['public_tokenizers'] = None
import __spark_entry__ as e
from pyspark.sql import SparkSession
q = e.queries(); assert len(q) > 100 and not any(n.startswith('op1_') for n in q)
spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()
assert q['import_list'](spark, '/root/testdata/sf0.001').count() == 3"""
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
