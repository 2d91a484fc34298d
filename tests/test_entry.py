import os
import pathlib
import shutil
import subprocess
import sys

from pyspark.sql import functions as F

import __spark_entry__ as entry_module

ROOT = pathlib.Path(__file__).resolve().parents[1]
CHECK = """
import __spark_entry__ as e
names = set(e.queries())
assert "office_hhi" in names and set(e.oracle_sql()) <= names
assert not any(n.startswith("op") or n == "pipeline" for n in names), names
"""


def test_entry_has_rows(spark):
    df = entry_module.entry(spark)
    assert df.columns == ["office", "hhi", "n_firms", "val"]
    assert df.where(F.col("hhi") > 0).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_the_rest_works_without_the_corpus_parts(tmp_path):
    shutil.copytree(ROOT / "awardlens", tmp_path / "awardlens", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    subprocess.run([sys.executable, "-c", CHECK], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True)
    (tmp_path / "awardlens/llm/__pycache__").mkdir(parents=True)  # an empty folder left behind
    subprocess.run([sys.executable, "-c", CHECK], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True)
    (tmp_path / "corpus_pipeline.py").write_text("from awardlens.llm import cnn, simhash\nfrom awardlens.llm.text import row_of\n")
    subprocess.run([sys.executable, "-c", CHECK], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True)
