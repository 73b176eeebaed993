"""The entry module, imported without a session, and what it registers."""

import subprocess
import sys

from .conftest import ROOT


def test_import_needs_no_session():
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    n, m = map(int, done.stdout.split()[-2:])
    assert 40 < m < n


def test_flagship(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
