"""The rest works without the training-data part, and workers find the package from any folder."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("pipeline", [True, False])
def test_import_without_the_training_data_part(tmp_path, pipeline):
    shutil.copytree(ROOT / "tallyweave", tmp_path / "tallyweave", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    if pipeline and (ROOT / "corpus_pipeline.py").exists():
        shutil.copy(ROOT / "corpus_pipeline.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), 'g_pairs' in e.queries(), any(k.startswith('op') for k in e.queries()))"], cwd=tmp_path, capture_output=True, text=True, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    n, there, llm = said.stdout.split()
    assert int(n) > 150 and there == "True" and llm == "False"


def test_workers_find_the_package_from_any_folder(tmp_path):
    code = f"""
import importlib.util, sys
from pyspark.sql import SparkSession
spec = importlib.util.spec_from_file_location("entry_module", {str(ROOT / "__spark_entry__.py")!r})
e = importlib.util.module_from_spec(spec)
spec.loader.exec_module(e)
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
e.queries()["g_pairs"](spark, "/root/testdata/sf0.001")
def found(batches):
    import tallyweave.plans.catalog as c
    for b in batches:
        yield b
print("rows", spark.range(3).mapInArrow(found, "id long").count())
"""
    (tmp_path / "run.py").write_text(code)
    said = subprocess.run([sys.executable, "run.py"], cwd=tmp_path, capture_output=True, text=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, timeout=300)
    assert "rows 3" in said.stdout, said.stderr[-2000:]
