"""Every registered query against its SQL on the given tables."""

import os
import shutil
import subprocess
import sys

import pytest
from compare import connect, differences

from suite.oracles import ORACLES
from suite.queries import QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, name):
    assert differences(QUERIES[name](spark, SF_DIR), con, ORACLES[name]) == []


def test_entry_runs(spark):
    import __spark_entry__ as contract

    assert contract.entry(spark).count() > 0
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_the_rest_works_without_the_training_text_folders(tmp_path):
    """A copy without the optional package, and then without the pipeline too, still has all other queries."""
    import __spark_entry__ as contract

    away = shutil.ignore_patterns(".git", "llm", "__pycache__")
    copy = shutil.copytree(contract.ROOT, tmp_path / "copy", ignore=away)
    asked = "import __spark_entry__ as e; print(sorted(e.queries()) == sorted(e.oracle_sql()), len(e.queries()))"
    for _ in range(2):
        done = subprocess.run([sys.executable, "-c", asked], cwd=copy, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": ""})
        assert done.stdout.split() == ["True", str(len(QUERIES))], done.stderr
        (copy / "corpus_pipeline.py").unlink(missing_ok=True)
