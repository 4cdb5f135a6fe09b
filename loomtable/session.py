"""Session helpers: checkpoint folder and size checks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

#: rows of a narrow table that may be broadcast; longer ones are sorted and merged
SMALL_ROWS = 200_000


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared folder; only an unset local session gets its own."""
    if spark.sparkContext.getCheckpointDir() is not None:
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        spark.sparkContext.setCheckpointDir(configured)
        return
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)



def stored(df: DataFrame) -> DataFrame:
    """Parquet in the shared folder, read back: the lineage is cut and Spark knows the true size."""
    ensure_checkpoint_dir(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def beside_large(df: DataFrame, times: int = 1) -> DataFrame:
    """The narrow side of a join with a much larger one: sent to all if its counted rows, ``times`` over, are few, else merged."""
    return F.broadcast(df) if df.count() * times <= SMALL_ROWS else df.hint("merge")
