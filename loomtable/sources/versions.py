"""Tables in committed versions: files in buckets of the key, one manifest per version.

A write puts Parquet files, one folder per bucket, into a folder of its own and then commits a manifest that lists the files of
every bucket.  The manifest appears by one rename, so a run that dies before it leaves the version before in force, and of two
writers of the same version one is refused.  An upsert reads and rewrites only the buckets that its rows fall into; all other
buckets of the new version are the files of the old one.  ``bucket_by`` are SQL expressions over the key columns, such as ``year(trade_date)``:
rows that come together should share buckets.

The manifest also keeps lineage (who made it, from what) and the last batch taken from each stream, so a batch that is sent again
is not applied again.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from loomtable.functions.checks import need_columns, need_some
from loomtable.operators.ordering import keep_one_per_key
from loomtable.registry import operator
from loomtable.sources.manifests import commit, content_of, names_in

VERSION_SCHEMA = ("version bigint, produced_by string, source_refs array<string>, keys array<string>, bucket_by array<string>, n_buckets bigint, "
                  "rewritten array<bigint>")
_BUCKET = "__bucket"


def _file(root: str, version: int) -> str:
    return f"{root}/versions/{version:012d}.json"


def _latest(spark: SparkSession, root: str) -> dict | None:
    names = names_in(spark, f"{root}/versions")
    return content_of(spark, f"{root}/versions/{names[-1]}") if names else None


def _bucket(manifest: dict):
    return F.pmod(F.xxhash64(*[F.expr(e) for e in manifest["bucket_by"]]), F.lit(manifest["n_buckets"]))


def _rows(spark: SparkSession, root: str, manifest: dict, buckets: set[int] | None = None) -> DataFrame:
    schema = T.StructType.fromJson(manifest["schema"])
    paths = [f"{root}/{p}" for b, p in manifest["files"].items() if buckets is None or int(b) in buckets]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _written(rows: DataFrame, root: str, manifest: dict) -> dict[str, str]:
    """The folder of each bucket that has rows."""
    folder = f"data/{uuid.uuid4().hex}"
    rows.withColumn(_BUCKET, _bucket(manifest)).repartition(_BUCKET).write.partitionBy(_BUCKET).parquet(f"{root}/{folder}")
    names = names_in(rows.sparkSession, f"{root}/{folder}")
    return {n.split("=")[1]: f"{folder}/{n}" for n in names if n.startswith(f"{_BUCKET}=")}


def _commit(spark: SparkSession, root: str, manifest: dict) -> DataFrame:
    if not commit(spark, _file(root, manifest["version"]), manifest):
        raise ValueError(f"version {manifest['version']} of {root} was committed by another writer")
    return _rows(spark, root, manifest)


@operator("write_version")
def write_version(df: DataFrame, root: str, keys: list[str], bucket_by: list[str] | None = None, n_buckets: int = 64, produced_by: str = "write_version",
                  source_refs: list[str] | None = None) -> DataFrame:
    """The whole table as the next version; of rows with one key the one with the highest ``load_seq`` stays."""
    need_some(keys, "key")
    need_columns(df, keys)
    if n_buckets < 1:
        raise ValueError("n_buckets must be positive")
    spark, before = df.sparkSession, _latest(df.sparkSession, root)
    rows = _one_per_key(df, keys)
    manifest = {"version": before["version"] + 1 if before else 1, "keys": keys, "bucket_by": bucket_by or [f"`{k}`" for k in keys], "n_buckets": n_buckets,
                "schema": json.loads(rows.schema.json()), "produced_by": produced_by, "source_refs": list(source_refs or []),
                "batches": before["batches"] if before else {}}
    manifest["files"] = _written(rows, root, manifest)
    manifest["rewritten"] = sorted(map(int, manifest["files"]))
    return _commit(spark, root, manifest)


@operator("upsert_version")
def upsert_version(batch: DataFrame, root: str, produced_by: str = "upsert_version", source_refs: list[str] | None = None,
                   stream: str | None = None, batch_id: int | None = None) -> DataFrame:
    """The next version with the batch's rows in place of those of equal key; only the buckets of the batch are rewritten.

    A batch of a stream that an earlier version has taken already changes nothing.
    """
    spark, before = batch.sparkSession, _latest(batch.sparkSession, root)
    if before is None:
        raise ValueError(f"{root} has no version yet")
    if stream is not None and before["batches"].get(stream, -1) >= batch_id:
        return _rows(spark, root, before)
    columns = [f["name"] for f in before["schema"]["fields"]]
    need_columns(batch, columns)
    rows = batch.select(*[F.col(f"`{c}`").cast(t.dataType) for c, t in zip(columns, T.StructType.fromJson(before["schema"]))],
                        *(["load_seq"] if "load_seq" in batch.columns and "load_seq" not in columns else []))
    touched = {r[0] for r in rows.select(_bucket(before).alias("b")).distinct().collect()}  # at most one number per bucket
    old = _rows(spark, root, before, touched).withColumn("__batch", F.lit(0))
    new = _one_per_key(rows, before["keys"]).withColumn("__batch", F.lit(1))
    merged = keep_one_per_key(old.unionByName(new), [F.col(f"`{k}`") for k in before["keys"]], [F.desc("__batch")]).drop("__batch")
    manifest = {**before, "version": before["version"] + 1, "produced_by": produced_by, "source_refs": list(source_refs or []),
                "batches": before["batches"] | ({stream: batch_id} if stream is not None else {}), "rewritten": sorted(touched)}
    manifest["files"] = before["files"] | (_written(merged, root, before) if touched else {})
    return _commit(spark, root, manifest)


def _one_per_key(df: DataFrame, keys: list[str]) -> DataFrame:
    if "load_seq" not in df.columns:
        return keep_one_per_key(df, [F.col(f"`{k}`") for k in keys], [F.col(f"`{c}`").desc() for c, t in df.dtypes if not t.startswith(("map", "variant"))])
    return keep_one_per_key(df, [F.col(f"`{k}`") for k in keys], [F.desc("load_seq")]).drop("load_seq")


@operator("read_version")
def read_version(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The rows of a version, the latest by default; later commits do not change what an earlier version shows."""
    manifest = _latest(spark, root) if version is None else content_of(spark, _file(root, version))
    if manifest is None:
        raise ValueError(f"{root} has no version" + ("" if version is None else f" {version}"))
    return _rows(spark, root, manifest)


@operator("table_versions")
def table_versions(spark: SparkSession, root: str) -> DataFrame:
    """One row per committed version: who made it, from what, and which buckets it rewrote."""
    return spark.read.schema(VERSION_SCHEMA).json(f"{root}/versions")


def stream_versions(stream: DataFrame, root: str, checkpoint: str, name: str, available_now: bool = True) -> StreamingQuery:
    """Upserts every micro-batch into the buckets it touches, each batch once."""
    def merge(batch: DataFrame, batch_id: int) -> None:
        upsert_version(batch, root, f"stream {name}", stream=name, batch_id=batch_id)

    writer = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
