import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.default.parallelism", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def golden(spark):
    from pairloom.schema import SITE

    rows = [("chr1", 0, 10, "A", "+"), ("chr1", 12, 20, "B", "+"), ("chr1", 15, 25, "A", "-"), ("chr1", 30, 40, "B", "-"), ("chr1", 40, 52, "A", "+"), ("chr1", 200, 210, "C", "."), ("chr2", 5, 15, "A", "+"), ("chr2", 16, 26, "B", "-")]
    return spark.createDataFrame([(i + 1, c, s, e, n, float(i), t) for i, (c, s, e, n, t) in enumerate(rows)], SITE).cache()
