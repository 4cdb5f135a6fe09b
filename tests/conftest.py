import shutil
import sys
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    folder = tempfile.mkdtemp(prefix="spark-")
    s = (SparkSession.builder.master("local[*]").appName("tests").config("spark.sql.shuffle.partitions", "8")
         .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
         .config("spark.checkpoint.dir", folder)
         .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
    shutil.rmtree(folder, ignore_errors=True)


@pytest.fixture
def frame(spark):
    """frame("a int, b string", (1, "x"), ...)"""
    return lambda schema, *rows: spark.createDataFrame(list(rows), schema)


def column(df, name, by=None):
    rows = df.orderBy(by).collect() if by else df.collect()
    return [r[name] for r in rows]


def rows(df, *by):
    return [tuple(r) for r in (df.orderBy(*by) if by else df).collect()]
