import os
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))

from cleargrain.session import configure  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    builder = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        # A few thousand rows per query: compiling each stage would take most of the time. TEST_CODEGEN=true
        # runs what users run.
        .config("spark.sql.codegen.wholeStage", os.environ.get("TEST_CODEGEN", "false"))
    )
    session = configure(builder, shuffle_partitions=4).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
