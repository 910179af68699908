"""Every query of the engine against its SQL."""

import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from helpers import same

from annomat.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return c


def test_every_query_has_sql():
    assert set(catalogue.queries()) == set(catalogue.oracle_sql())


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_equals_sql(spark, small, duck, name):
    assert same(catalogue.queries()[name](spark, small), duck.sql(catalogue.oracle_sql()[name]))


def test_entry_module():
    import __spark_entry__ as entry

    assert set(catalogue.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def _names(root, *gone):
    """Names of the queries of a copy of the repository without some of its parts."""
    here = Path(__file__).resolve().parent.parent
    shutil.copytree(here, root, ignore=lambda top, _: {Path(g).name for g in (*gone, ".git") if (here / g).parent == Path(top)})
    code = "import __spark_entry__ as e; print(' '.join(e.queries())); assert set(e.oracle_sql()) <= set(e.queries())"
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=root, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(root)}, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    return set(done.stdout.split())


@pytest.mark.parametrize("gone", [("annomat/llm", "tests/llm"), ("annomat/llm", "tests/llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)])
def test_entry_module_without_optional_parts(tmp_path, gone):
    names = _names(tmp_path / "copy", *gone)
    assert set(catalogue.queries()) <= names and "pipeline" not in names
    assert any(n.startswith("op") and n[2:3].isdigit() for n in names) == ("annomat/llm" not in gone and (Path(__file__).resolve().parent.parent / "annomat/llm").exists())
