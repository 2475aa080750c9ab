"""The entry's queries where the training-data subpackage is absent."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
PROBE = """
import __spark_entry__
names = set(__spark_entry__.queries())
assert "p6_time" in names and len(names) > 70, names
assert "pipeline" not in names and not any(n.startswith("op") for n in names), names
assert set(__spark_entry__.oracle_sql()) <= names
"""


@pytest.mark.parametrize("kept", ["corpus_pipeline.py", None])
def test_without_the_subpackage(tmp_path, kept):
    shutil.copytree(ROOT / "modetrace", tmp_path / "modetrace", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", *([kept] if kept and (ROOT / kept).exists() else [])):
        shutil.copy(ROOT / name, tmp_path)
    run = subprocess.run([sys.executable, "-c", PROBE], cwd=tmp_path, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"}, capture_output=True, text=True, timeout=120)
    assert run.returncode == 0, run.stderr
