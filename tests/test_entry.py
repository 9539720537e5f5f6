"""The driver's contract."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.oracle_sql()) > 40


def test_the_core_stands_alone(tmp_path):
    root = Path(entry.__file__).parent
    code = "import sys; sys.modules['headway.llm'] = None; import __spark_entry__ as e; assert 'p1_found' in e.queries() and 'p6_found' not in e.queries()"
    assert subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True).returncode == 0


def test_entry_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1
