"""The entry module without the optional subpackage."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_queries_load_without_the_optional_parts(tmp_path):
    """Neither a missing folder nor a leftover cache folder keeps the other queries from loading."""
    for name in ("broadsheet", "__spark_entry__.py"):
        source = os.path.join(ROOT, name)
        shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__")) if os.path.isdir(source) else shutil.copy(source, tmp_path / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 80 and set(e.oracle_sql()) <= set(q) and not any(n.startswith('op1_') or n == 'pipeline' for n in q)"
    for leftover in (None, tmp_path / "broadsheet" / "llm" / "__pycache__"):
        if leftover:
            os.makedirs(leftover)
        done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=120)
        assert done.returncode == 0, done.stderr
