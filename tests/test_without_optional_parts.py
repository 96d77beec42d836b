"""The library stands without its optional subpackage, whether or not the pipeline on top of it is still there."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
OPTIONAL = "llm"
NAMES = "import __spark_entry__ as e; print(*e.queries(), *e.oracle_sql())"


@pytest.mark.parametrize("gone", [(), ("corpus_pipeline.py",)])
def test_entry_imports_without_the_subpackage(tmp_path, gone):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", OPTIONAL, *gone))
    found = subprocess.run([sys.executable, "-c", NAMES], cwd=copy, capture_output=True, text=True, timeout=120)
    assert found.returncode == 0, found.stderr
    names = found.stdout.split()
    assert "tracking_metrics" in names and not [x for x in names if x.startswith("op") and x[2:3].isdigit() or x == "pipeline"]


def test_other_import_errors_are_not_swallowed(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", OPTIONAL))
    (copy / "corpus_pipeline.py").write_text("import no_such_module\n")
    found = subprocess.run([sys.executable, "-c", NAMES], cwd=copy, capture_output=True, text=True, timeout=120)
    assert found.returncode and "no_such_module" in found.stderr
