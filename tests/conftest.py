import os
import sys
import tempfile

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("fencewatch-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.warehouse.dir", "/tmp/fencewatch-warehouse")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="fencewatch-tests-"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def one(spark):
    """Evaluate a column expression on one text: one(text, fn)."""

    def run(text, fn):
        from pyspark.sql import functions as F

        frame = spark.createDataFrame([(text,)], "t string")
        return frame.select(fn(F.col("t")).alias("v")).first()["v"]

    return run


@pytest.fixture(scope="session")
def many(spark):
    """Evaluate a column expression on several texts at once."""

    def run(texts, fn):
        from pyspark.sql import functions as F

        frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1)
        rows = frame.select("i", fn(F.col("t")).alias("v")).orderBy("i").collect()
        return [row["v"] for row in rows]

    return run
