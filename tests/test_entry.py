"""The driver's contract: names, SQL and the core without the optional subpackage."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
SMALL = Path("/root/testdata/sf0.001")


def test_names_and_sql():
    sys.path.insert(0, str(ROOT))
    import __spark_entry__ as entry

    names, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(names) and all(callable(f) for f in names.values())
    assert {f"p{n}_found" for n in (2, 3, 4, 5)} <= set(names)


def test_imports_without_a_session_and_without_the_subpackage():
    code = "import sys; sys.modules['playledger.llm'] = None; sys.path.insert(0, '.'); import __spark_entry__ as e; assert not any(n.startswith('p6') for n in e.queries()); assert 'p3_found' in e.queries()"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=ROOT, check=True, timeout=120)


@pytest.mark.skipif(not SMALL.exists(), reason="no test data")
def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["requested_date", "player_id", "change_kind"]
