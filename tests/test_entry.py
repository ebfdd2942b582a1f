"""The entry module needs no session to be imported."""

import subprocess
import sys
from pathlib import Path


def test_entry_imports_without_a_session():
    code = "import __spark_entry__ as e; assert len(e.queries()) >= len(e.oracle_sql()) > 80"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).resolve().parents[1])
