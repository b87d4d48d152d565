"""The entry point, with and without the subpackage that can be taken away."""

from __future__ import annotations

import re
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


def names(folder: Path) -> list[str]:
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q); print('NAMES', *q)"
    out = subprocess.run([sys.executable, "-c", code], cwd=folder, capture_output=True, text=True, timeout=120, check=True)
    return out.stdout.rpartition("NAMES")[2].split()


@pytest.mark.parametrize("leftover", [False, True])
def test_without_the_subpackage(tmp_path, leftover):
    for part in ("seqspark", "__spark_entry__.py"):
        (shutil.copytree if (ROOT / part).is_dir() else shutil.copy)(ROOT / part, tmp_path / part)
    shutil.rmtree(tmp_path / "seqspark" / "llm", ignore_errors=True)
    if leftover:
        (tmp_path / "seqspark" / "llm" / "__pycache__").mkdir(parents=True)
    got = names(tmp_path)
    assert "j06_shared_kmer_pairs" in got and not any(re.match(r"op\d+_|pipeline$", n) for n in got)


def test_nothing_else_imports_the_subpackage():
    for path in (ROOT / "seqspark").rglob("*.py"):
        if "llm" not in path.parts:
            assert "llm" not in path.read_text()


def test_with_all():
    got = names(ROOT)
    assert len(got) == len(set(got)) and "a23_subgroup_report" in got
