"""The engine without the training-data operators: what is left imports and runs."""

import os
import re
import shutil
import subprocess
import sys

import pytest

from tests.conftest import ROOT

CODE = """
import __spark_entry__ as e
from pyspark.sql import SparkSession
names = set(e.queries())
assert names and not any(n.startswith("op") or n == "pipeline" for n in names) and set(e.oracle_sql()) <= names
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
assert e.entry(spark).count() > 0
print("fine")
"""


@pytest.mark.parametrize("pipeline", [True, False])
def test_without_the_folders(tmp_path, pipeline):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", "*.json", "*.md"))
    if not pipeline:
        (tmp_path / "repo" / "corpus_pipeline.py").unlink(missing_ok=True)
    env = os.environ | {"PYTHONPATH": str(tmp_path / "repo")}
    got = subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path / "repo", env=env, capture_output=True, text=True, timeout=300)
    assert got.stdout.strip().endswith("fine"), got.stderr[-2000:]


def test_nothing_else_imports_them():
    for folder, _, names in os.walk(os.path.join(ROOT, "strandline")):
        if "llm" not in folder.split(os.sep):
            for n in names:
                if n.endswith(".py"):
                    with open(os.path.join(folder, n), encoding="utf-8") as f:
                        assert not re.search(r"strandline\.llm|import llm|corpus_pipeline", f.read()), n
