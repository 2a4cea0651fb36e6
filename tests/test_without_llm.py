import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_rest_imports_alone():
    code = "import sys; sys.modules['lumenweave.llm'] = None; import __spark_entry__ as e; assert len(e.queries()) > 100 and 'p2_found' in e.queries() and 'p1_found' not in e.queries()"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT).returncode == 0


def test_every_oracle_has_a_query():
    sys.path.insert(0, ROOT)
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
