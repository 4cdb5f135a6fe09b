"""Writing tables out: delimited text and bundles of named tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomtable.registry import operator

MANIFEST_SCHEMA = "position int, name string, path string, format string, columns array<string>, types array<string>"
BUNDLE_NULL = "\\N"


@operator("export_csv")
def export_csv(df: DataFrame, path: str, null_text: str = "null") -> str:
    """Header row, every cell quoted (quotes doubled, line breaks and outer blanks kept), null written as ``null_text``.
    Choose a text that no cell holds if the table is to be read back."""
    (df.write.option("header", True).option("nullValue", null_text).option("escape", '"').option("quoteAll", True)
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    return path


@operator("import_csv")
def import_csv(spark: SparkSession, path: str, null_text: str = "null", schema: str | None = None) -> DataFrame:
    """Reads what ``export_csv`` wrote; without a schema every column is text."""
    reader = (spark.read.option("header", True).option("nullValue", null_text).option("escape", '"')
              .option("multiLine", True).option("emptyValue", ""))
    return (reader.schema(schema) if schema else reader).csv(path)


@operator("export_bundle")
def export_bundle(tables: dict[str, DataFrame], root: str, fmt: str = "parquet") -> DataFrame:
    """One folder per named table and a manifest table; the manifest comes back."""
    if not tables:
        raise ValueError("a bundle needs at least one table")
    if fmt not in ("parquet", "csv"):
        raise ValueError(f"unknown format {fmt!r}")
    rows = []
    for i, (name, df) in enumerate(tables.items()):
        path = f"{root}/{name}"
        if fmt == "csv":
            export_csv(df, path, BUNDLE_NULL)
        else:
            df.write.parquet(path)
        rows.append((i, name, path, fmt, df.columns, [t for _, t in df.dtypes]))
    spark = next(iter(tables.values())).sparkSession
    manifest = spark.createDataFrame(rows, MANIFEST_SCHEMA)
    manifest.coalesce(1).write.parquet(f"{root}/manifest")
    return manifest


@operator("load_bundle")
def load_bundle(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    rows = spark.read.schema(MANIFEST_SCHEMA).parquet(f"{root}/manifest").orderBy("position").collect()
    ddl = lambda r: ", ".join(f"`{c}` {t}" for c, t in zip(r["columns"], r["types"]))
    return {r["name"]: (spark.read.parquet(r["path"]) if r["format"] == "parquet"
                        else import_csv(spark, r["path"], BUNDLE_NULL, ddl(r))) for r in rows}


@operator("verify_artifacts")
def verify_artifacts(spark: SparkSession, path: str, manifest: DataFrame, folders: bool = False) -> DataFrame:
    """SHA-256 of files against a manifest (file_name, sha256): matched, mismatch or missing.  With ``folders`` a file's
    name is its place below ``path``, otherwise its last part."""
    name = (F.substring_index("path", path.split("://")[-1].removeprefix("file:").rstrip("/") + "/", -1) if folders
            else F.element_at(F.split("path", "/"), -1))
    found = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
             .select(name.alias("file_name"),
                     F.sha2("content", 256).alias("actual_sha256")))
    return compare_hashes(manifest, found)


@operator("compare_hashes")
def compare_hashes(manifest: DataFrame, found: DataFrame) -> DataFrame:
    out = manifest.select("file_name", F.lower("sha256").alias("expected_sha256")).join(
        found.select("file_name", "actual_sha256"), "file_name", "left")
    status = (F.when(F.col("actual_sha256").isNull(), "missing")
              .when(F.col("actual_sha256") == F.col("expected_sha256"), "matched").otherwise("mismatch"))
    return out.withColumn("status", status)
