"""The entry without the llm subpackage, and without a library that it needs."""

import shutil
import subprocess
import sys
from pathlib import Path

TOP = Path(__file__).resolve().parent.parent
COUNT = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), sum(n.startswith('op') for n in e.queries()))"


def _run(code, folder):
    out = subprocess.run([sys.executable, "-c", code], cwd=folder, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    return list(map(int, out.stdout.split()))


def test_the_rest_stands_without_llm(tmp_path):
    shutil.copytree(TOP / "twinlake", tmp_path / "twinlake", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(TOP / "__spark_entry__.py", tmp_path)
    queries, oracles, llm = _run(COUNT, tmp_path)
    assert queries == oracles > 60 and llm == 0


def test_a_missing_library_costs_the_llm_queries_only():
    queries, oracles, llm = _run("import sys; sys.modules['zstandard'] = None; " + COUNT, TOP)
    assert queries == oracles > 60 and llm == 0
