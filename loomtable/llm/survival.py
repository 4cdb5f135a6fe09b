"""Filter interaction audit: what each filter removes in every order, from one survival word per document.

A document that fails a set F of filters survives a subset S of them if S and F share none.  Its survival word has one bit for
each of the 32 subsets of five filters.  The words of a part (and, of these, the words of good and of toxic documents) are summed
by a carry-save positional popcount: full adders over whole words halve the number of words until two of each weight are left,
so 32 counts come out at once.  Every figure of every order is a difference of these counts.

Filters, over whole texts (null: empty; words are maximal runs of bytes other than space and \\t \\n \\v \\f \\r):
A fewer than 50 words; B 100 * distinct words < 65 * words; C 100 * [A-Z] > 5 * code points; D holds one of # $ % & * |;
E equal to the text of a row with a smaller id, whatever happens to that row.

Texts are read once; afterwards rows are an id, a part, a digest (SHA-256) and five bits.  Groups of copies meet only as partial
minima; the join that brings the minimum back has two shuffled sides, which AQE splits where a group is large.  Counts leave a
task as one row per part and batch.

Defined results: a null part counts as the empty string; a null id is smaller than none and larger than none, so it neither fails
E nor makes others fail; rows that share the smallest id and the text all pass E; repeated rows count each; a document is good
(toxic) if any label of its id says 1, a null id has no labels; labels without document are ignored; without documents the result is empty.  Extra columns are
not read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from loomtable.llm.tables import columns, written

FILTERS = "ABCDE"
SUBSETS = 1 << len(FILTERS)
LABELS = ("all", "good", "toxic")
#: the survival word of each set of failed filters
WORD_OF = [sum(1 << s for s in range(SUBSETS) if not s & failed) for failed in range(SUBSETS)]
_UPPER = bytes(range(65, 91))
_INNER = bytes(range(0x80, 0xC0))
_SYMBOL = re.compile(rb"[#$%&*|]")
_SPACE = re.compile(rb"[ \t-\r]")
_PIECE = 8 << 20


def _word_counts(text: bytes) -> tuple[int, int]:
    """(words, distinct words); a very long text is split piece by piece, between words."""
    n, distinct, at = 0, set(), 0
    while at < len(text):
        cut = _SPACE.search(text, at + _PIECE) if len(text) - at > _PIECE else None
        end = cut.start() if cut else len(text)
        words = text[at:end].split()
        n += len(words)
        distinct.update(words)
        at = end
    return n, len(distinct)


def failed_alone(text: bytes) -> int:
    """Bits of the failed filters A to D."""
    n, distinct = _word_counts(text)
    upper = len(text) - len(text.translate(None, _UPPER))
    points = len(text.translate(None, _INNER))
    return ((n < 50) | (100 * distinct < 65 * n) << 1 | (100 * upper > 5 * points) << 2 | (_SYMBOL.search(text) is not None) << 3)


def survival_words(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source",
                   quality_col: str = "quality", toxic_col: str = "toxic") -> DataFrame:
    """id, part, failed (five bits), word (32 bits), good, toxic: one row per document row."""
    given = columns(docs, id=id_col, text=text_col, part=part_col).withColumn("part", F.coalesce(F.col("part").cast("string"), F.lit("")))
    kind = given.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                texts = [t or b"" for t in batch.column(1).slice(at, 256).cast(pa.large_binary()).to_pylist()]
                yield pa.record_batch([
                    batch.column(0).slice(at, 256), batch.column(2).slice(at, 256),
                    pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()),
                    pa.array([failed_alone(t) for t in texts], pa.int32())], names=["id", "part", "digest", "alone"])

    rows = written(given.mapInArrow(run, f"id {kind}, part string, digest binary, alone int"))
    firsts = written(rows.filter("id is not null").groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
                     .filter("n > 1").select(F.col("digest").alias("d"), "first"))
    said = columns(labels, key=id_col, quality=quality_col, toxic=toxic_col).filter("key is not null")
    said = written(said.groupBy("key").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
                   .filter("good or toxic"))
    out = rows.join(firsts, F.col("digest") == F.col("d"), "left").join(said, F.col("id") == F.col("key"), "left")
    failed = F.col("alone") + F.when(F.col("id") > F.col("first"), 16).otherwise(0)
    word = F.element_at(F.array(*[F.lit(w).cast("long") for w in WORD_OF]), F.col("failed") + 1)
    return (out.select("id", "part", failed.alias("failed"), F.coalesce("good", F.lit(False)).alias("good"),
                       F.coalesce("toxic", F.lit(False)).alias("toxic")).withColumn("word", word))


def positional_popcount(words: np.ndarray) -> np.ndarray:
    """How many of the 32-bit words have each bit: carry-save addition, weight by weight."""
    counts, weight, level = np.zeros(32, np.int64), 0, words.astype("<u4")
    while len(level):
        carries = []
        while len(level) > 2:
            third = len(level) // 3
            a, b, c = level[:third], level[third:2 * third], level[2 * third:3 * third]
            half = a ^ b
            carries.append((a & b) | (half & c))
            level = np.concatenate([half ^ c, level[3 * third:]])
        bits = np.unpackbits(level.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
        counts += bits.sum(0, dtype=np.int64) << weight
        level, weight = np.concatenate(carries) if carries else level[:0], weight + 1
    return counts


def subset_survivors(words: DataFrame) -> DataFrame:
    """part, n: 96 counts, the survivors of each subset among all, good and toxic documents of the part."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column(0).dictionary_encode()
            code = part.indices.to_numpy(zero_copy_only=False)
            order = np.argsort(code, kind="stable")
            word = batch.column(1).to_numpy(zero_copy_only=False)[order].astype(np.uint32)
            good, toxic = (batch.column(i).to_numpy(zero_copy_only=False)[order] for i in (2, 3))
            ends = np.cumsum(np.bincount(code, minlength=len(part.dictionary)))
            counts = [np.concatenate([positional_popcount(w) for w in (word[a:b], word[a:b][good[a:b]], word[a:b][toxic[a:b]])])
                      for a, b in zip([0, *ends[:-1]], ends)]
            yield pa.record_batch([part.dictionary, pa.array([c.tolist() for c in counts], pa.list_(pa.int64()))], names=["part", "n"])

    counted = words.select("part", "word", "good", "toxic").mapInArrow(run, "part string, n array<bigint>")
    sums = counted.groupBy("part").agg(*[F.sum(F.col("n")[i]).alias(f"n{i}") for i in range(len(LABELS) * SUBSETS)])
    return sums.select("part", F.array(*[f"n{i}" for i in range(len(LABELS) * SUBSETS)]).alias("n"))


def audit(survivors: DataFrame) -> DataFrame:
    """part, filter_order, step and the figures of the step's filter: 600 rows per part."""
    orders = ["".join(p) for p in permutations(FILTERS)]
    steps = []
    for order in orders:
        before = 0
        for letter in order:
            bit = 1 << FILTERS.index(letter)
            steps.append((before, before | bit, FILTERS.index(letter)))
            before |= bit
    n = F.col("n")

    def summed(bit: int):
        return sum(math.factorial(s.bit_count()) * math.factorial(len(FILTERS) - 1 - s.bit_count()) * (n[s] - n[s | bit])
                   for s in range(SUBSETS) if not s & bit)

    per_filter = survivors.select(
        "part", "n", F.array(*[summed(1 << i) for i in range(len(FILTERS))]).alias("shapleys"),
        F.array(*[n[0] - n[1 << i] for i in range(len(FILTERS))]).alias("fails"),
        F.array(*[n[SUBSETS - 1 - (1 << i)] - n[SUBSETS - 1] for i in range(len(FILTERS))]).alias("only"))
    rows = per_filter.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(len(steps) - 1))))

    def looked_up(values: list):
        return F.array(*[F.lit(v) for v in values])

    rows = rows.select("*", looked_up([s[0] for s in steps])[F.col("i")].alias("before"), looked_up([s[1] for s in steps])[F.col("i")].alias("after"),
                       looked_up([s[2] for s in steps])[F.col("i")].alias("filter"))
    lost = [n[F.col("before") + SUBSETS * i] - n[F.col("after") + SUBSETS * i] for i in range(len(LABELS))]
    return rows.select(
        "part", looked_up(orders)[(F.col("i") / len(FILTERS)).cast("int")].alias("filter_order"), (F.col("i") % len(FILTERS) + 1).cast("int").alias("step"),
        n[F.col("after")].alias("kept"), lost[0].alias("removed"), (F.col("fails")[F.col("filter")] - lost[0]).alias("redundant"),
        F.col("only")[F.col("filter")].alias("unique_fails"), lost[1].alias("good_lost"), lost[2].alias("toxic_lost"),
        F.col("shapleys")[F.col("filter")].alias("shapley"))


def filter_audit(docs: DataFrame, labels: DataFrame, **names: str) -> DataFrame:
    """The whole audit; ``names`` are the column names that ``survival_words`` takes."""
    return audit(subset_survivors(survival_words(docs, labels, **names)))
