import os
import subprocess
import sys

import harness
import pytest

from docloom.plans import registry

SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def con(small):
    return harness.connect(small)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_agrees_with_its_sql(spark, small, con, name):
    assert harness.differences(registry.queries()[name](spark, small), con, SQL[name]) is None


def test_entry(spark, small):
    import __spark_entry__

    assert set(registry.queries()) <= set(__spark_entry__.queries())
    assert registry.flagship(spark, small).columns == ["query_id", "doc_id", "final_rank", "exact_hit", "fused_score"]


def test_modules_are_imported_without_a_session():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert len(e.queries()) >= len(e.oracle_sql()) > 0"], cwd=root, check=True)
