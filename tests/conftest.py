import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]")
        .appName("convolytics-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    from convolytics.session import checkpoint_dir

    checkpoint_dir(s, default=tempfile.mkdtemp(prefix="convolytics-ckpt-", dir="/tmp"))
    yield s
    s.stop()


@pytest.fixture(autouse=True, scope="module")
def nothing_stays_cached(spark):
    """A table that one module leaves cached would be in the plans of the next."""
    yield
    spark.catalog.clearCache()


@pytest.fixture()
def tmp_dir():
    return tempfile.mkdtemp(prefix="convolytics-test-", dir="/tmp")
