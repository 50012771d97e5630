"""The driver contract, with and without the removable subpackage."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
LIST = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(*q)"


def names_in(folder: Path) -> list[str]:
    said = subprocess.run([sys.executable, "-B", "-c", LIST], cwd=folder, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(folder)}, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr
    return said.stdout.split()


@pytest.mark.parametrize("leftovers", [False, True])
def test_runs_without_the_subpackage(tmp_path, leftovers):
    shutil.copytree(ROOT / "tidelog", tmp_path / "tidelog", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    if leftovers:
        (tmp_path / "tidelog/llm/__pycache__").mkdir(parents=True)
    names = names_in(tmp_path)
    assert len(names) > 50 and "pipeline" not in names and not any(n.startswith("op") and n[2].isdigit() for n in names)


def test_nothing_else_imports_the_subpackage():
    for p in ROOT.rglob("*.py"):
        inside = p.relative_to(ROOT).parts
        if "llm" not in inside and inside[-1] not in ("__spark_entry__.py", "corpus_pipeline.py", "test_entry.py"):
            assert "llm" not in p.read_text(), p


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
