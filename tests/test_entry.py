"""The entry module with and without the optional subpackage."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
CODE = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), 'pipeline' in e.queries(), sum(q.startswith('op') for q in e.queries()))"


@pytest.mark.parametrize("with_pipeline", [True, False])
def test_import_without_the_subpackage(tmp_path, with_pipeline):
    skipped = shutil.ignore_patterns(".git", "llm", "__pycache__", "" if with_pipeline else "corpus_pipeline.py")
    shutil.copytree(ROOT, tmp_path / "copy", ignore=skipped)
    environment = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path / "copy", env=environment, capture_output=True, text=True, timeout=120)
    assert run.returncode == 0, run.stderr
    queries, oracles, pipeline, operators = run.stdout.split()
    assert int(queries) > 60 and int(oracles) > 60 and pipeline == "False" and operators == "0"
