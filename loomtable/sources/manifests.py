"""Small JSON files that become visible whole or not at all, on any file system Spark reads."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def commit(spark: SparkSession, path: str, content: dict) -> bool:
    """Writes the content beside its place and moves it there by one rename; False if the place is taken."""
    final = _path(spark, path)
    conf, fs_package = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs
    fs = final.getFileSystem(conf)
    draft = fs_package.Path(final.getParent(), f".{final.getName()}-{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(json.dumps(content, sort_keys=True).encode())
    out.close()
    rename = getattr(fs_package, "Options$Rename")
    never = spark.sparkContext._gateway.new_array(rename, 1)
    never[0] = rename.NONE
    place = fs.makeQualified(final)
    try:
        fs_package.FileContext.getFileContext(place.toUri(), conf).rename(fs.makeQualified(draft), place, never)
    except Py4JJavaError as e:
        fs.delete(draft, False)
        if "FileAlreadyExists" in e.java_exception.getClass().getName():
            return False
        raise
    return True


def content_of(spark: SparkSession, path: str) -> dict | None:
    """The committed content, or None."""
    place = _path(spark, path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return None
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """Names of the committed files of a folder, sorted; drafts are not among them."""
    place = _path(spark, folder)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(place):
        return []
    return sorted(n for n in (s.getPath().getName() for s in fs.listStatus(place)) if not n.startswith("."))
