import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_queries_are_listed_without_a_session():
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert len(q) > 190 and set(s) <= set(q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=ROOT, check=True, timeout=120)
