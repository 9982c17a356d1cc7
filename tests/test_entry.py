"""The driver's entry without the optional corpus operators."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("also", [[], ["corpus_pipeline.py"]])
def test_queries_without_the_corpus_operators(tmp_path, also):
    left_out = shutil.ignore_patterns(".git", "llm", "__pycache__", "spark-warehouse", *also)
    copy = shutil.copytree(ROOT, tmp_path / "copy", ignore=left_out)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert 'top_counterparties_amount' in q and set(o) <= set(q); assert not any(k == 'pipeline' or k[:2] == 'op' and k[2].isdigit() for k in q)"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, timeout=120, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYTHONPATH": ""})


def test_every_sql_has_its_query():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
