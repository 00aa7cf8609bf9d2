"""The driver's contract, with and without the corpus operators."""

import os
import shutil
import subprocess
import sys

import __spark_entry__

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and "revenue" in df.columns


def test_names():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_without_corpus_operators(tmp_path):
    to = tmp_path / "repo"
    shutil.copytree(ROOT, to, ignore=shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pricing_summary' in q and 'pipeline' not in q and not [k for k in q if k[:2] == 'op' and k[2].isdigit()], list(q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=to, check=True, env={**os.environ, "PYTHONPATH": str(to)})
