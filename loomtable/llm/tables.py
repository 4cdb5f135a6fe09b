"""Small helpers shared by the operators: written intermediate tables and id columns."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomtable.session import ensure_checkpoint_dir


def scratch(spark: SparkSession) -> str:
    """A new folder below the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/llm-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """Writes the rows to the shared folder and reads them back: the lineage is cut, lost executors
    cost nothing, and Spark knows the true size when it chooses between joins."""
    spark, path = df.sparkSession, scratch(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_keyed(df: DataFrame, id_col: str, text_col: str, name: str = "_row_key") -> DataFrame:
    """The rows with a key of their own, in the order of their ids, null ids last, then of fingerprints of their texts.

    Ids that are there and differ are such keys already; otherwise the rows are written once, so that no later run can
    renumber them."""
    id_, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    counts = df.groupBy(id_.alias("id")).agg(F.count("*").alias("n"))
    if not counts.filter("n > 1 or id is null").limit(1).count():
        return df.withColumn(name, id_)
    return written(df.withColumn(name, F.struct(
        id_.isNull().alias("none"), id_.alias("id"), F.xxhash64(text).alias("print"), F.monotonically_increasing_id().alias("no"))))


def columns(df: DataFrame, **names: str) -> DataFrame:
    """Only the named columns, under the operator's own names; other columns cannot clash."""
    return df.select(*[F.col(f"`{old}`").alias(new) for new, old in names.items()])


def possibly_among(df: DataFrame, key: str, ids: DataFrame, id_col: str, bits: int = 24) -> DataFrame:
    """The rows whose key's fingerprint is marked by one of the ids, before a join that decides exactly."""
    return marked(df, key, ids, id_col, bits).filter("_possible").drop("_possible")


def marked(df: DataFrame, key: str, ids: DataFrame, id_col: str, bits: int = 24) -> DataFrame:
    """The rows with ``_possible``: false only where no id has the key.

    The marks are a bitmap of fixed size (at most 2 ** (bits - 6) rows of 64 marks), so its broadcast is bounded whatever
    the number of ids; with many more ids than marks it only lets more rows through."""
    def place(c):
        return F.xxhash64(c).bitwiseAND(F.lit((1 << bits) - 1))

    marks = (ids.select(place(F.col(id_col)).alias("h"))
             .groupBy(F.shiftright("h", 6).alias("_word")).agg(F.expr("bit_or(shiftleft(1L, cast(h & 63 as int)))").alias("_mask")))
    placed = df.withColumn("_h", place(F.col(key))).withColumn("_word", F.shiftright("_h", 6))
    return (placed.join(F.broadcast(written(marks)), "_word", "left")
            .withColumn("_possible", F.expr("coalesce(shiftright(_mask, cast(_h & 63 as int)) & 1 = 1, false)"))
            .drop("_h", "_word", "_mask"))
