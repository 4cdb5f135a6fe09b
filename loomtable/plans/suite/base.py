"""Registration of queries and readers of the given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loomtable.session import ensure_checkpoint_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return register


class Tables:
    """``Tables(spark, dir).lineitem`` reads ``dir/lineitem.parquet``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")


def scratch_folder(spark: SparkSession) -> str:
    """A new folder in the shared checkpoint folder, for results written and read back."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/results-{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """The rows written to a scratch folder and read back."""
    path = scratch_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def rounded(df: DataFrame, columns: list[str], digits: int = 4) -> DataFrame:
    """Doubles are rounded as SQL engines round them, the scaled number to a whole one; Spark's own rounding goes by the printed digits,
    which differs where a quotient ends in a 5 just behind them (0.0015625)."""
    kinds, scale = dict(df.dtypes), 10.0 ** digits
    return df.withColumns({c: F.round(F.col(f"`{c}`") * scale) / scale if kinds[c] == "double" else F.round(F.col(f"`{c}`"), digits)
                           for c in columns})


def day_text(c: str | Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")
