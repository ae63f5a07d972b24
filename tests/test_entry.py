"""The driver's contract."""

import subprocess
import sys

import __spark_entry__ as e


def test_contract(spark):
    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q) and e.entry(spark).count() > 0


def test_core_does_not_need_the_text_package():
    code = "import sys; sys.modules['pointloom.llm'] = None; import __spark_entry__ as e; assert 'b1_activate' in e.queries() and not any(n.startswith('op') for n in e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=e.__file__.rsplit("/", 1)[0])
