"""Repeated runs of lines by a suffix array over line identities.

Lines that occur once cannot be in a repeated run, so they only end segments: the suffix array covers the positions of lines that
occur at least twice, and a segment's end counts as a terminator of its own.  Prefix doubling runs as joins and sorts: in each round a
position's rank and the rank ``h`` lines on form a pair, the distinct pairs are sorted over all tasks, and their order gives
the new ranks.  Rounds end when no pair occurs twice.  Neighbours in the sorted order give the longest common prefixes: they
are compared only where the preceding lines differ, all others follow by subtracting one (the sum of the compared lengths is n log n).
Prefix intervals of at least ``min_lines`` lines are repeated runs; of each, the occurrence that comes first (by id,
then line) stays, and the lines of the others are deleted.

Groups of equal lines are never gathered: pairs and intervals are pre-aggregated, sorts break ties by position, and only one
row per sorted partition reaches the driver.  A document's own lines are the largest unit.

Defined results: lines are split at \\n and compared exactly; a null or empty text has no lines; a null id comes first; rows with
equal id and text are one document with a row each in the result; different texts under one id are documents in the
order of their fingerprints; runs never cross documents but may overlap or repeat within one; empty tables give empty results.
Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, Window

from loomtable.llm.tables import columns, marked, written


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """d (id and text fingerprint), text."""
    given = columns(docs, id=id_col, text=text_col)
    return given.select(F.struct("id", F.xxhash64("text").alias("print")).alias("d"), F.coalesce("text", F.lit("")).alias("text"))


def repeated_lines(documents: DataFrame) -> DataFrame:
    """d, pos, line (fingerprint), seg (first position of its run of repeated lines): the lines that occur at least twice."""
    hashed = documents.select("d", F.when(F.col("text") != "", F.transform(F.split("text", "\n"), lambda x: F.xxhash64(x))).alias("lines"))
    one = hashed.groupBy("d").agg(F.first("lines").alias("lines"))
    lines = written(one.select("d", F.posexplode("lines").alias("pos", "line")))
    often = lines.groupBy("line").agg(F.count("*").alias("n")).filter("n > 1").select("line")
    again = lines.join(often, "line")
    order = Window.partitionBy("d").orderBy("pos")
    return again.withColumn("seg", F.col("pos") - F.row_number().over(order)).withColumn(
        "seg", F.min("pos").over(Window.partitionBy("d", "seg"))).select("d", "pos", "line", "seg")


def _numbered(pairs: DataFrame, *keys: str) -> DataFrame:
    """The rows with an order-preserving number from a sort over all tasks; written, so that no later run can renumber."""
    return written(pairs.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("next", F.monotonically_increasing_id() + 1))


def suffix_ranks(lines: DataFrame) -> DataFrame:
    """d, pos, line, seg, rank: equal ranks only for positions whose segments end alike."""
    ranks, h = lines.withColumn("rank", F.col("line")), 1
    order = Window.partitionBy("d").orderBy("pos")
    while True:
        there = F.lead("pos", h).over(order) == F.col("pos") + h
        paired = written(ranks.withColumn("r2", F.when(there, F.lead("rank", h).over(order))))
        pairs = paired.groupBy("rank", "r2").agg(F.count("*").alias("n"))
        numbers = _numbered(pairs, "rank", "r2")
        more = numbers.filter("n > 1 and r2 is not null").limit(1).count()
        named = numbers.select(F.col("rank").alias("o1"), F.col("r2").alias("o2"), "next")
        ranks = (paired.join(named, (F.col("rank") == F.col("o1")) & F.col("r2").eqNullSafe(F.col("o2")))
                 .select("d", "pos", "line", "seg", F.col("next").alias("rank")))
        if not more:
            return written(ranks)
        h *= 2


def _with_previous(rows: DataFrame, keys: list[str], carried: list[str]) -> DataFrame:
    """Each row with ``q``: the carried columns of the row before it in the order over all tasks."""
    part = F.spark_partition_id()
    ordered = written(rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
                      .withColumn("part", part).withColumn("at", F.monotonically_increasing_id()))
    ends = ordered.groupBy("part").agg(F.max(F.struct("at", *carried)).alias("last"))
    # one row per sorted partition
    before = ends.select(F.col("part").alias("p"), F.lag("last").over(Window.orderBy("part")).alias("q0"))
    # numbers are consecutive within a partition
    shifted = ordered.select((F.col("at") + 1).alias("at"), F.struct("at", *carried).alias("q1"))
    return (ordered.join(shifted, "at", "left").join(F.broadcast(before), F.col("part") == F.col("p"))
            .withColumn("q", F.coalesce("q1", F.when((F.col("at") % (1 << 33)) == 0, F.col("q0"))))
            .drop("q0", "q1", "p"))


def common_prefixes(ranks: DataFrame) -> DataFrame:
    """d, pos, rank, lcp: lines in common with the suffix before, in the order of the suffix array."""
    order = Window.partitionBy("d", "seg").orderBy("pos")
    left = ranks.withColumn("before", F.lag("line").over(order))
    near = written(_with_previous(left, ["rank", "d", "pos"], ["d", "pos", "seg", "line", "before"]))
    apart = F.col("before").isNull() | F.col("q.before").isNull() | (F.col("before") != F.col("q.before"))
    own = written(near.withColumn("apart", F.coalesce(apart, F.lit(True))).withColumn("same", F.coalesce(F.col("line") == F.col("q.line"), F.lit(False))))
    segments = written(ranks.groupBy("d", "seg").agg(F.sort_array(F.collect_list(F.struct("pos", "line"))).alias("s"))
                       .select("d", "seg", F.col("s.line").alias("tail")))
    asked = own.filter("apart and same").select("d", "pos", "seg", F.col("q.d").alias("qd"), F.col("q.seg").alias("qseg"), F.col("q.pos").alias("qpos"))
    both = (asked.join(segments, ["d", "seg"]).join(segments.select(F.col("d").alias("qd"), F.col("seg").alias("qseg"), F.col("tail").alias("qtail")), ["qd", "qseg"])
            .select("d", "pos", (F.col("pos") - F.col("seg")).alias("i"), (F.col("qpos") - F.col("qseg")).alias("j"), "tail", "qtail"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, j, x, y in zip(*(batch.column(k) for k in (2, 3, 4, 5))):
                a, b = x.values.to_numpy()[i.as_py():], y.values.to_numpy()[j.as_py():]
                n = min(len(a), len(b))
                unlike = np.flatnonzero(a[:n] != b[:n])
                out.append(int(unlike[0]) if len(unlike) else n)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(out, pa.int64())], names=["d", "pos", "found"])

    kind = ranks.schema["d"].dataType.simpleString()
    found = both.mapInArrow(run, f"d {kind}, pos int, found long")
    known = own.join(found, ["d", "pos"], "left").withColumn(
        "base", F.when(F.col("apart"), F.coalesce("found", F.lit(0)) + F.col("pos")))
    # where the preceding lines agree, the prefix is that of the preceding position less one line
    return known.withColumn("lcp", F.greatest(F.last("base", ignorenulls=True).over(order) - F.col("pos"), F.lit(0))).select("d", "pos", "rank", "lcp")


def repeated_runs(lines: DataFrame, min_lines: int) -> DataFrame:
    """d, pos, lcp: positions where a run of ``min_lines`` lines starts that also starts earlier."""
    prefixes = common_prefixes(suffix_ranks(lines))
    keys = ["rank", "d", "pos"]
    cut = F.col("lcp") < min_lines
    ordered = written(prefixes.repartitionByRange(*keys).sortWithinPartitions(*keys)
                      .withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()))
    # an interval is named by the place where it begins; those that begin in an earlier partition are found from one row per partition
    named = ordered.withColumn("begin", F.max(F.when(cut, F.col("at"))).over(
        Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)))
    ends = named.groupBy("part").agg(F.max("begin").alias("last"))
    before = ends.select(F.col("part").alias("p"), F.max("last").over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("open"))
    whole = written(named.join(F.broadcast(before), F.col("part") == F.col("p")).withColumn("begin", F.coalesce("begin", "open"))
                    .select("d", "pos", "lcp", "begin"))
    first = whole.groupBy("begin").agg(F.min(F.struct("d", "pos")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    return whole.join(first, "begin").filter(F.struct("d", "pos") != F.col("first")).select("d", "pos", "lcp")


def without_repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = 2) -> DataFrame:
    """id, n_lines, n_removed, n_runs (maximal deleted runs), kept_text."""
    documents = _documents(docs, id_col, text_col)
    later = repeated_runs(repeated_lines(documents), min_lines)
    starts = written(later.groupBy("d").agg(F.sort_array(F.collect_list("pos")).alias("starts")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, at in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                lines = text.split("\n") if text else []
                gone = np.zeros(len(lines) + 1, bool)
                for s in at or ():
                    gone[s:s + min_lines] = True
                kept = "\n".join(x for x, g in zip(lines, gone) if not g)
                out.append((len(lines), int(gone.sum()), int((gone[1:] < gone[:-1]).sum()), kept))
            cols = list(zip(*out)) or [[]] * 4
            yield pa.record_batch([batch.column(0), *[pa.array(c, pa.int64()) for c in cols[:3]], pa.array(cols[3], pa.string())],
                                  names=["id", "n_lines", "n_removed", "n_runs", "kept_text"])

    kind = docs.schema[id_col].dataType.simpleString()
    # only texts that may lose lines are shuffled to meet their starts
    texts = marked(documents, "d", starts, "d")
    joined = (texts.filter("_possible").join(starts, "d", "left").select("d", "text", "starts")
              .unionByName(texts.filter("not _possible").select("d", "text", F.lit(None).cast("array<int>").alias("starts")))
              .select(F.col("d.id").alias("id"), "text", "starts"))
    return joined.mapInArrow(run, f"id {kind}, n_lines long, n_removed long, n_runs long, kept_text string").withColumnRenamed("id", id_col)
