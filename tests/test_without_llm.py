"""The rest of the library stands without the training-data package."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_nothing_else_imports_it():
    for f in (ROOT / "vecmill").rglob("*.py"):
        if "llm" not in f.relative_to(ROOT).parts:
            assert "llm" not in f.read_text(), f


def test_entry_without_it(tmp_path):
    import shutil

    shutil.copytree(ROOT / "vecmill", tmp_path / "vecmill", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'maxsim_topk' in q and 'pipeline' not in q; assert e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
