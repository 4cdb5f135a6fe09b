"""Upserts fed by a stream: each micro-batch becomes one folder of a key's
history, and reading takes the latest row per key.

A batch is written to its own folder with overwrite, so a batch that runs again
after a failure replaces itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from loomtable.operators.ordering import keep_one_per_key


def stream_upserts(stream: DataFrame, root: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/load_batch={batch_id}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def current_rows(spark: SparkSession, root: str, keys: list[str], order_in_batch: list[str] | None = None) -> DataFrame:
    """Latest row per key; within a batch the last by ``order_in_batch``."""
    rows = spark.read.option("basePath", root).parquet(root)
    order = [F.desc("load_batch"), *[F.desc(c) for c in order_in_batch or []]]
    return keep_one_per_key(rows, [F.col(k) for k in keys], order).drop("load_batch")
