"""Every query of the library against its SQL on the smallest fixture; the others return rows."""

from __future__ import annotations

import pytest

from loam.queries import QUERIES, SQL
from tests.oracle import assert_same, connect

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, connection, name):
    df = QUERIES[name](spark, SF_DIR)
    if name in SQL:
        assert_same(df, connection, SQL[name])
    else:
        assert df.count() > 0


def test_entry_works_without_the_training_operators(tmp_path):
    """The entry point imports, and has the library's own queries, where the subpackage is not there."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "loam", tmp_path / "loam", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), sum(k.startswith('op') for k in e.queries()))"
    said = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin"}, capture_output=True, text=True, check=True)
    assert said.stdout.split() == [str(len(QUERIES)), "0"]
