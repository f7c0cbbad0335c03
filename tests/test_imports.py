import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry_imports_without_a_session():
    """And names one callable for each query, with SQL for known queries only."""
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 100 and set(o) <= set(q) and all(map(callable, q.values()))"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
