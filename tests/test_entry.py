"""The driver's contract, with and without the training-data subpackage."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
CODE = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q), sum(n.startswith('op') or n == 'pipeline' for n in q if n[2:3].isdigit() or n == 'pipeline'))"


def test_flagship(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns[:2] == ["conv_id", "turn"] and df.count() > 0


def test_import_without_the_subpackage(tmp_path):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py"))
    out = subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path / "repo", env={"PATH": "/usr/bin:/bin", "PYTHONPATH": ""}, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr
    total, llm = map(int, out.stdout.split())
    assert total > 40 and llm == 0
