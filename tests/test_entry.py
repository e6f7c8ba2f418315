"""The entry module in a fresh interpreter, before any session exists."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_queries_can_be_listed_without_a_session():
    code = "import __spark_entry__ as e; q = e.queries(); o = e.oracle_sql(); assert set(o) <= set(q) and len(o) > 50"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
