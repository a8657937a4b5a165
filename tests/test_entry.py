"""The entry module, with and without the optional subpackage."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_smoke(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_rest_imports_without_the_subpackage(tmp_path):
    shutil.copytree(ROOT / "turnloom", tmp_path / "turnloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and not any(n[:2] == 'op' and n[2:3].isdigit() or n == 'pipeline' for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True, timeout=120)


def test_nothing_else_imports_the_subpackage():
    for path in (ROOT / "turnloom").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "turnloom.llm" not in path.read_text(), path
