"""The driver's contract, with and without the corpus subpackage."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("pipeline", [True, False])
def test_without_the_corpus_operators(tmp_path, pipeline):
    """The folders of the corpus operators are deleted, with corpus_pipeline.py or without."""
    for name in ("orrery", "__spark_entry__.py", *(["corpus_pipeline.py"] if pipeline else [])):
        (shutil.copytree if (ROOT / name).is_dir() else shutil.copy)(ROOT / name, tmp_path / name)
    shutil.rmtree(tmp_path / "orrery" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and set(e.oracle_sql()) <= set(q) and not [n for n in q if n.startswith('op') and n[2:3].isdigit() or n == 'pipeline']"
    env = os.environ | {"PYTHONPATH": str(tmp_path)}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True)


def test_nothing_else_names_the_subpackage():
    for path in (ROOT / "orrery").rglob("*.py"):
        if "llm" not in path.parts:
            assert "orrery.llm" not in path.read_text()
