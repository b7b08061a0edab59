"""The entry and the bench without the training-data operators."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent

LOAD = """
import __spark_entry__ as e
import bench
assert e.queries() and set(e.oracle_sql()) <= set(e.queries())
assert not any(q == "pipeline" or q.startswith("op") for q in e.queries()), sorted(e.queries())
"""


def loaded(folder):
    return subprocess.run([sys.executable, "-c", LOAD], cwd=folder, capture_output=True, text=True, timeout=120)


def test_entry_loads_without_the_folders_of_training_data(tmp_path):
    for left_out in (["llm"], ["llm", "corpus_pipeline.py"]):
        copy = tmp_path / f"copy{len(left_out)}"
        shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse", *left_out))
        run = loaded(copy)
        assert run.returncode == 0, run.stderr
