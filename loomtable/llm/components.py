"""Connected components of a link table by label passing with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from loomtable.llm.tables import written


def connected(links: DataFrame, a: str, b: str) -> DataFrame:
    """id, comp: the smallest id reachable, for every id that has a link.

    Each round takes the smallest label among a node and its neighbours, then the label's own label, so
    long chains shorten by more than half.  Rounds end when no label changes; only that count reaches the driver."""
    both = written(links.select(F.col(a).alias("id"), F.col(b).alias("other"))
                   .unionByName(links.select(F.col(b).alias("id"), F.col(a).alias("other"))).distinct())
    labels = written(both.groupBy("id").agg(F.min("other").alias("m")).select("id", F.least("id", "m").alias("comp")))
    while True:
        seen = both.join(labels.withColumnRenamed("id", "other"), "other").groupBy("id").agg(F.min("comp").alias("m"))
        near = labels.join(seen, "id").select("id", F.col("comp").alias("old"), F.least("comp", "m").alias("comp"))
        up = labels.select(F.col("id").alias("comp"), F.col("comp").alias("above"))
        jumped = written(near.join(up, "comp", "left").select("id", "old", F.least("comp", F.coalesce("above", "comp")).alias("comp")))
        labels = jumped.select("id", "comp")
        if not jumped.filter("comp < old").limit(1).count():
            return labels
