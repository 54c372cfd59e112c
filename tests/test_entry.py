import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry
import pytest

from trajspark import catalog

ROOT = Path(__file__).resolve().parent.parent


def test_contract(spark):
    q, o = entry.queries(), entry.oracle_sql()
    assert o.keys() <= q.keys() and len(q) > 90
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_every_query_runs(spark, data, name):
    """On the smallest data; values are compared with SQL elsewhere."""
    catalog.queries()[name](spark, data).collect()


def test_nothing_else_imports_the_optional_subpackage():
    for f in (ROOT / "trajspark").rglob("*.py"):
        if "llm" not in f.relative_to(ROOT).parts:
            assert "trajspark.llm" not in f.read_text(), f


def test_the_rest_works_without_it(tmp_path):
    import shutil

    shutil.copytree(ROOT / "trajspark", tmp_path / "trajspark", ignore=lambda d, names: ["llm"] if d.endswith("trajspark") else [])
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'p3_found' in q and 'p1_found' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin", "PYTHONPATH": str(tmp_path)})
