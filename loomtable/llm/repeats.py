"""Bytes that repeat: every byte covered by a 100-byte string that also starts earlier is removed.

Every string has an anchor that depends on its bytes alone: the smallest fingerprint of its 32-byte grams, leftmost on ties.  Equal
strings therefore have equal anchors at equal offsets, and one row per anchor stands for the run of strings that share it.

1. Anchors are dealt by fingerprint.  Of rows whose whole run of strings is the same, all but the first are settled: each string
   is a later copy.  Anchors that occur once, or with one run only, need nothing more.
2. The first rows of the other anchors are cut into pieces of up to 20 strings that share a core of 81 bytes, and dealt by core.
   Again equal pieces settle all but the first.
3. The different pieces of a core go through a suffix array by linear grouping (``grouping_sort``), the core counted as one symbol:
   neighbours whose common prefix reaches 20 symbols hold the same 100-byte string, and of each such prefix interval all but
   the first occurrence are later copies.

A core with more than ``group_rows`` different pieces is cut on into single strings, which are pre-aggregated by
fingerprint; the answer is the same and no group is gathered in one task.  Only rows leave the steps, never texts: the spans found are joined to
the texts once at the end.  Fingerprints have 64 bits, and equal runs agree in two of them.

Defined results: a null or empty text has no bytes; texts of under 100 bytes lose nothing; ids order the documents; null or repeated ids (rows
that share an id are documents of their own, in the order of their texts' fingerprints, null first) make the operator number the rows first;
overlaps within a document count; an empty table gives an empty result.  Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, Window

from loomtable.llm.grouping_sort import suffix_array
from loomtable.llm.tables import columns, written
from loomtable.llm.words import batches_of_bytes, prefix_sums, range_hash

LENGTH, GRAM, STEP = 100, 32, 20
REACH = LENGTH - GRAM + 1  # grams in a string
CORE = LENGTH - STEP + 1


def anchors(text: np.ndarray, sums: np.ndarray, start: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor fingerprint, anchor, first string, last string) for the runs of strings of text[start:end] that share an anchor."""
    at = np.arange(start, end - GRAM + 1)
    value = range_hash(sums, at, at + GRAM)
    where, low, width = at, value, 1
    while width < REACH:
        step = min(width, REACH - width)
        right = low[step:] < low[:-step]
        where = np.where(right, where[step:], where[:-step])
        low = np.where(right, low[step:], low[:-step])
        width += step
    edge = np.flatnonzero(np.diff(where)) + 1
    first = np.concatenate([[0], edge])
    last = np.concatenate([edge - 1, [len(where) - 1]])
    return low[first], where[first], first + start, last + start


def _anchor_rows(docs: DataFrame) -> DataFrame:
    """a (anchor), r (its run of strings), no, lo, hi (first and last string), at (anchor's place), known (an equal row of the same
    chunk is earlier, so this one is a later copy whatever else there is)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nos = batch.column(0).to_numpy()
            for k, texts in batches_of_bytes(batch.column(1)):
                parts = []
                for i, t in enumerate(texts):
                    if len(t) >= LENGTH:
                        data = np.frombuffer(t, np.uint8)
                        sums = prefix_sums(data, False)
                        a, at, lo, hi = anchors(data, sums, 0, len(data))
                        r = range_hash(sums, lo, hi + LENGTH) ^ ((at - lo).astype(np.uint64) << np.uint64(40))
                        parts.append((a, r, np.full(len(a), nos[k + i]), lo, hi, at))
                if parts:
                    a, r, no, lo, hi, at = (np.concatenate(c) for c in zip(*parts))
                    order = np.lexsort((at, no, r, a))
                    known = np.zeros(len(a), bool)
                    known[order[1:]] = (a[order[1:]] == a[order[:-1]]) & (r[order[1:]] == r[order[:-1]])
                    yield pa.record_batch([pa.array(a.view(np.int64)), pa.array(r.view(np.int64)), pa.array(no, pa.int64()),
                                           pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(known)],
                                          names=["a", "r", "no", "lo", "hi", "at", "known"])

    return docs.mapInArrow(run, "a long, r long, no long, lo int, hi int, at int, known boolean")


def _settled(rows: DataFrame, key: str, same: str, *order: str) -> DataFrame:
    """Rows whose key occurs more than once: with ``later`` (an equal row is first) and ``differs`` (the key has unlike rows).
    One exchange by key serves both windows; rows already known to be later copies are dealt out evenly instead, so copies
    do not gather under one key."""
    if "known" in rows.columns:
        settled = F.col("known")
        rows = rows.withColumn("k", F.when(settled, F.xxhash64(*order)).otherwise(F.col(key))).withColumn(
            same, F.when(~settled, F.col(same)))
        key = "k"
    else:
        settled = F.lit(False)
    whole = Window.partitionBy(key)
    return (rows.repartition(key)
            .withColumn("later", settled | (F.row_number().over(Window.partitionBy(key, same).orderBy(*order)) > 1))
            .withColumn("differs", F.min(same).over(whole) < F.max(same).over(whole))
            .filter("later or differs"))


def _pieces(asked: DataFrame) -> DataFrame:
    """c (core), s (whole piece), no, lo, lead (bytes before the core), strings (in the piece), piece: asked has (no, text, runs of (lo, hi, at))."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for no, text, runs in zip(batch.column(0), batch.column(1), batch.column(2)):
                raw = text.as_py()
                sums = prefix_sums(np.frombuffer(raw, np.uint8), False)
                own = runs.values
                lo, hi, at = (own.field(f).to_numpy().astype(np.int64) for f in ("lo", "hi", "at"))
                cut = []
                for j in range(0, REACH, STEP):
                    first, last = np.maximum(lo, at - j - STEP + 1), np.minimum(hi, at - j)
                    some = first <= last
                    core = (at - j)[some]
                    cut.append((core, first[some], last[some], np.full(len(core), j)))
                core, first, last, j = (np.concatenate(c) for c in zip(*cut))
                key = range_hash(sums, core, core + CORE) + j.astype(np.uint64)
                same = range_hash(sums, first, last + LENGTH) ^ ((core - first).astype(np.uint64) << np.uint64(40))
                yield pa.record_batch([
                    pa.array(key.view(np.int64)), pa.array(same.view(np.int64)), pa.array(np.full(len(core), no.as_py()), pa.int64()),
                    pa.array(first.astype(np.int32)), pa.array((core - first).astype(np.int32)), pa.array((last - first + 1).astype(np.int32)),
                    pa.array([raw[x:y + LENGTH] for x, y in zip(first.tolist(), last.tolist())], pa.binary())],
                    names=["c", "s", "no", "lo", "lead", "strings", "piece"])

    return asked.mapInArrow(run, "c long, s long, no long, lo int, lead int, strings int, piece binary")


def later_strings(pieces: list[tuple[int, int, int, int, int, bytes]]) -> Iterator[tuple[int, int]]:
    """(no, start) of the strings that also start earlier; pieces are (core, no, lo, lead, strings, bytes)."""
    text, owner = [], []
    names: dict[int, int] = {}
    for core, no, lo, lead, strings, raw in pieces:
        text += [b + 2 for b in raw[:lead]]
        text.append(names.setdefault(core, 258 + len(names)))
        text += [b + 2 for b in raw[lead + CORE:]]
        text.append(1)
        owner += [(no, lo + i) if i < strings else None for i in range(lead + 1)]
        owner += [None] * (len(text) - len(owner))
    text.append(0)
    held: list[tuple[int, int]] = []
    prefix: list[int] = []
    for i in suffix_array(text):
        if i >= len(owner) or owner[i] is None:
            continue
        own = text[i:i + STEP]
        if own != prefix:
            if len(held) > 1:
                yield from sorted(held)[1:]
            held, prefix = [], own
        held.append(owner[i])
    if len(held) > 1:
        yield from sorted(held)[1:]


def _sorted_groups(pieces: DataFrame, most_symbols: int = 20000) -> DataFrame:
    """no, lo, hi: later strings among the pieces of each core; rows arrive by core, and whole cores share a suffix array."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None

        def flush():
            found = list(later_strings(held))
            start = pa.array([s for _, s in found], pa.int32())
            return pa.record_batch([pa.array([n for n, _ in found], pa.int64()), start, start], names=["no", "lo", "hi"])

        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(6))):
                if row[0] != last and size > most_symbols:
                    yield flush()
                    held, size = [], 0
                last = row[0]
                held.append(row)
                size += len(row[5]) - CORE + 2
        if held:
            yield flush()

    return pieces.select("c", "no", "lo", "lead", "strings", "piece").mapInArrow(run, "no long, lo int, hi int")


def _single_strings(pieces: DataFrame) -> DataFrame:
    """no, lo, hi: later strings among pieces of very frequent cores, one pre-aggregated row per string."""
    each = pieces.select("c", "no", F.posexplode(F.sequence(F.lit(0), F.col("strings") - 1)).alias("i", "_"), "lo", "lead", "piece").select(
        F.xxhash64("c", F.col("lead") - F.col("i"), F.expr(f"substring(piece, i + 1, {LENGTH})")).alias("h"), "no", (F.col("lo") + F.col("i")).alias("lo"))
    first = each.groupBy("h").agg(F.min(F.struct("no", "lo")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    return each.join(first, "h").filter(F.struct("no", "lo") != F.col("first")).select("no", "lo", F.col("lo").alias("hi"))


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, no (orders the documents), text as bytes."""
    given = columns(docs, id=id_col, text=text_col).withColumn("text", F.coalesce(F.col("text").cast("binary"), F.lit(b"")))
    whole = given.schema["id"].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint")
    if whole and not given.groupBy("id").count().filter("count > 1 or id is null").limit(1).count():
        return given.withColumn("no", F.col("id").cast("long"))
    order = ["id", F.xxhash64("text"), "text"]
    return written(given.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("no", F.monotonically_increasing_id()))


def later_copies(docs: DataFrame, group_rows: int) -> DataFrame:
    """no, lo, hi: the first and last start of strings that also start earlier."""
    rows = written(_settled(_anchor_rows(docs.select("no", "text")), "a", "r", "no", "at").select("no", "lo", "hi", "at", "later"))
    asked = rows.filter("not later").groupBy("no").agg(F.collect_list(F.struct("lo", "hi", "at")).alias("runs"))
    pieces = _pieces(docs.join(asked, "no").select("no", "text", "runs"))
    settled = written(_settled(pieces, "c", "s", "no", "lo"))
    unlike = settled.filter("not later and differs")
    often = written(unlike.groupBy("c").agg(F.count("*").alias("n")).filter(F.col("n") > group_rows).select("c"))
    few = unlike.join(often, "c", "left_anti").repartition("c").sortWithinPartitions("c")
    return (rows.filter("later").select("no", "lo", "hi")
            .unionByName(settled.filter("later").select("no", "lo", (F.col("lo") + F.col("strings") - 1).alias("hi")))
            .unionByName(_sorted_groups(few)).unionByName(_single_strings(unlike.join(often, "c"))))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_rows: int = 5000) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept (the remaining bytes)."""
    numbered = _numbered(docs, id_col, text_col)
    spans = later_copies(numbered, group_rows).groupBy("no").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(batch.column(1), batch.column(2)):
                raw = text.as_py()
                turn = np.zeros(len(raw) + 1, np.int32)
                if spans.is_valid:
                    np.add.at(turn, spans.values.field("lo").to_numpy(), 1)
                    np.add.at(turn, spans.values.field("hi").to_numpy() + LENGTH, -1)
                gone = np.cumsum(turn)[:-1] > 0
                kept = np.frombuffer(raw, np.uint8)[~gone].tobytes() if gone.any() else raw
                starts = int(gone[:1].sum() + (gone[1:] > gone[:-1]).sum())
                out.append((len(raw), int(gone.sum()), starts, kept))
            cols = list(zip(*out)) or [[]] * 4
            yield pa.record_batch([batch.column(0), *[pa.array(c, pa.int64()) for c in cols[:3]], pa.array(cols[3], pa.binary())],
                                  names=["id", "n_bytes", "n_removed", "n_spans", "kept"])

    kind = docs.schema[id_col].dataType.simpleString()
    return (numbered.join(spans, "no", "left").select("id", "text", "spans")
            .mapInArrow(run, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept binary").withColumnRenamed("id", id_col))
