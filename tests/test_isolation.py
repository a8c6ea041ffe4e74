"""The library works without the training-data operators and the pipeline."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def run_in(folder: Path, code: str) -> str:
    done = subprocess.run([sys.executable, "-c", code], cwd=folder, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    return done.stdout


def test_everything_else_works_when_the_training_data_folders_are_deleted(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse"))
    for path in (copy / "quillgrove" / "llm", copy / "tests" / "llm"):
        shutil.rmtree(path, ignore_errors=True)
    (copy / "corpus_pipeline.py").unlink(missing_ok=True)
    count = "import __spark_entry__ as e, bench; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q); print(len(q), any(k.startswith('op1_') or k == 'pipeline' for k in q))"
    left, any_llm = run_in(copy, count).split()
    assert int(left) > 50 and any_llm == "False"
