"""The driver's contract, and that the library stands without the training-data subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).resolve().parent.parent


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_stands_alone(tmp_path):
    shutil.copytree(ROOT / "decisia", tmp_path / "decisia", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; names = e.queries(); assert len(names) > 80 and not any(n.startswith('op') and n[2].isdigit() or n == 'pipeline' for n in names)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})


def test_nothing_else_imports_the_subpackage():
    for path in (ROOT / "decisia").rglob("*.py"):
        if "llm" not in path.parts:
            assert "decisia.llm" not in path.read_text(), path
