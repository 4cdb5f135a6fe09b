"""Ranked lexical search: one automaton of all item terms scans the texts; no index of the documents is built.

Terms are maximal runs of ASCII letters and digits and of characters beyond ASCII, A-Z folded.  In a text every other byte becomes one
guard byte, and the Aho-Corasick automaton holds each item term between two guards, so it reports whole terms only; neighbours may
share a guard.  The terms of the items are read in blocks of bounded bytes; a block's automaton, weights and term-to-item lists are
broadcast and the texts are scanned twice: once for the number of documents N, their terms L and each term's document frequency,
once for scores.  A task keeps the best rows of each item only, and the best of the tasks are ranked in two rounds (by task group,
then by item), so no task gets a row for every task.

A term weighs w = floor(1000 * ln((2N + 2) / (2 df + 1))); with m = 75 + (25 n N) div L for a document of n terms, its score is the sum
of w * ((10^9 tf) div (1000 tf + 12 m)) over the item's terms with repeats, in 64-bit integers.

Defined results: null and empty texts have no terms and are not among N; an item without terms finds nothing; equal scores are ranked
by ascending id, null ids last; each row of the benchmark is an item of its own, and each row of the documents a document, so
repeated ids come back repeated; empty tables give an empty result.  Extra columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from loomtable.llm.tables import columns
from loomtable.llm.words import batches_of_bytes

_FOLD = bytes(0 if not (48 <= i < 58 or 65 <= i < 91 or 97 <= i < 123 or i > 127) else i + 32 if 65 <= i < 91 else i for i in range(256))
_CELLS = 1 << 21
_GROUPS = 256


def terms(text: bytes) -> list[str]:
    return [t.decode() for t in text.translate(_FOLD).split(b"\0") if t]


class Scan:
    """The automaton of a block of items."""

    def __init__(self, items: list[tuple[object, bytes]]):
        asked = [Counter(terms(t)) for _, t in items]
        self.ids = [i for i, _ in items]
        self.vocabulary = sorted(set().union(*asked)) if asked else []
        number = {t: i for i, t in enumerate(self.vocabulary)}
        uses = sorted((number[t], item, times) for item, c in enumerate(asked) for t, times in c.items())
        self.item = np.array([u[1] for u in uses], np.int64)
        self.times = np.array([u[2] for u in uses], np.int64)
        self.first = np.searchsorted(np.array([u[0] for u in uses], np.int64), np.arange(len(self.vocabulary) + 1))
        self.automaton = ahocorasick.Automaton()
        for t, i in number.items():
            self.automaton.add_word(f"\0{t}\0", i)
        if number:
            self.automaton.make_automaton()

    def counts(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Terms of each text, then (text, term, occurrences) of the item terms found."""
        folded = b"\0" + b"\0".join(t.translate(_FOLD) for t in texts) + b"\0"
        data = np.frombuffer(folded, np.uint8)
        at = np.cumsum([1, *(len(t) + 1 for t in texts)])
        starts = np.flatnonzero((data[1:] != 0) & (data[:-1] == 0)) + 1
        n = np.diff(np.searchsorted(starts, at))
        if not self.vocabulary:
            return n, *[np.zeros(0, np.int64)] * 3
        points = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=points[1:])
        found = np.fromiter(chain.from_iterable(self.automaton.iter(folded.decode())), np.int64).reshape(-1, 2)
        text = np.searchsorted(points[at], found[:, 0] - 1, side="right") - 1
        key, tf = np.unique(text * len(self.vocabulary) + found[:, 1], return_counts=True)
        return n, key // len(self.vocabulary), key % len(self.vocabulary), tf

    def scores(self, text: np.ndarray, term: np.ndarray, gain: np.ndarray, n_texts: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(text, item, score) of all pairs with a score above 0, a bounded number of texts at a time."""
        width = np.diff(self.first)[term]
        first = np.searchsorted(text, np.arange(n_texts + 1))
        upto = np.concatenate([[0], np.cumsum(width)])[first]
        a = 0
        while a < n_texts:
            b = a + 1
            while b < n_texts and (b + 1 - a) * len(self.ids) <= _CELLS and upto[b + 1] - upto[a] <= _CELLS:
                b += 1
            rows = slice(first[a], first[b])
            many = width[rows]
            use = np.repeat(self.first[term[rows]] - np.cumsum(many) + many, many) + np.arange(many.sum())
            cells = np.zeros((b - a) * len(self.ids), np.int64)
            np.add.at(cells, np.repeat((text[rows] - a) * len(self.ids), many) + self.item[use], np.repeat(gain[rows], many) * self.times[use])
            there = np.flatnonzero(cells)
            yield there // len(self.ids) + a, there % len(self.ids), cells[there]
            a = b


def item_blocks(items: DataFrame, most_bytes: int) -> Iterator[list[tuple[object, bytes]]]:
    block, size = [], 0
    for row in items.toLocalIterator():
        text = (row.text or "").encode()
        if block and size + len(text) > most_bytes:
            yield block
            block, size = [], 0
        block.append((row.id, text))
        size += len(text)
    if block:
        yield block


def corpus_counts(docs: DataFrame, shared) -> tuple[int, int, list[int]]:
    """N, L and the document frequency of each term of the block: at most two rows more than the block has terms."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = Scan(shared.value)
        df, n_docs, n_terms = np.zeros(len(scan.vocabulary), np.int64), 0, 0
        for batch in batches:
            for _, texts in batches_of_bytes(batch.column(1)):
                n, _, term, _ = scan.counts(texts)
                df += np.bincount(term, minlength=len(df))
                n_docs, n_terms = n_docs + int((n > 0).sum()), n_terms + int(n.sum())
        some = np.flatnonzero(df)
        yield pa.record_batch([pa.array([-2, -1, *some.tolist()], pa.int64()), pa.array([n_docs, n_terms, *df[some].tolist()], pa.int64())],
                              names=["term", "n"])

    found = dict(docs.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect())
    size = 1 + max(found, default=-1)
    return found.get(-2, 0), found.get(-1, 0), [found.get(i, 0) for i in range(size)]


def best_documents(docs: DataFrame, benchmark: DataFrame, top: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                   item_text_col: str = "text", block_bytes: int = 4 << 20) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` documents of each item, best first."""
    given, items = columns(docs, id=id_col, text=text_col), columns(benchmark, id=item_col, text=item_text_col)
    kinds = {"id": given.schema["id"].dataType, "item": items.schema["id"].dataType}
    schema = f"no long, item {kinds['item'].simpleString()}, id {kinds['id'].simpleString()}, score long"
    context, out, offset = docs.sparkSession.sparkContext, None, 0
    for block in item_blocks(items, block_bytes):
        shared = context.broadcast(block)
        n_docs, n_terms, df = corpus_counts(given, shared)
        weight = context.broadcast([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df])

        def run(batches: Iterator[pa.RecordBatch], shared=shared, weight=weight, total=(n_docs, n_terms), offset=offset) -> Iterator[pa.RecordBatch]:
            scan = Scan(shared.value)
            w = np.array(weight.value, np.int64)
            best, floor = None, np.zeros(len(scan.ids), np.int64)
            for batch in batches:
                for at, texts in batches_of_bytes(batch.column(1)):
                    n, text, term, tf = scan.counts(texts)
                    sizes, which = np.unique(n, return_inverse=True)
                    m = np.array([75 + 25 * s * total[0] // max(total[1], 1) for s in sizes.tolist()], np.int64)[which]
                    gain = w[term] * (1_000_000_000 * tf // (1000 * tf + 12 * m[text]))
                    for d, item, score in scan.scores(text, term, gain, len(texts)):
                        good = score >= floor[item]
                        found = pa.table({"no": item[good], "id": batch.column(0).take(pa.array(at + d[good])), "score": score[good]})
                        best = _ranked(found if best is None else pa.concat_tables([best, found]), top)
                        no = best.column("no").to_numpy()
                        full = np.flatnonzero(np.bincount(no, minlength=len(floor)) >= top)
                        floor[full] = best.column("score").to_numpy()[np.searchsorted(no, full, side="right") - 1]
            if best is not None:
                for part in best.to_batches():
                    no = part.column("no").to_numpy()
                    yield pa.record_batch([pa.array(no + offset), pa.array([scan.ids[i] for i in no], item_type), part.column("id"), part.column("score")],
                                          names=["no", "item", "id", "score"])

        item_type = pa.int64() if schema.split(", ")[1] == "item bigint" else pa.int32() if schema.split(", ")[1] == "item int" else pa.string()
        found = given.mapInArrow(run, schema)
        out, offset = found if out is None else out.unionByName(found), offset + len(block)
    if out is None:
        out = docs.sparkSession.createDataFrame([], schema)
    order = [F.desc("score"), F.asc_nulls_last("id")]
    near = out.withColumn("group", F.spark_partition_id() % _GROUPS)
    near = near.withColumn("rank", F.row_number().over(Window.partitionBy("no", "group").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("no").orderBy(*order))).filter(F.col("rank") <= top)
    return ranked.select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score")


def _ranked(rows: pa.Table, top: int) -> pa.Table:
    """The best rows of each item, sorted by item, score and id."""
    rows = rows.sort_by([("no", "ascending"), ("score", "descending"), ("id", "ascending")])
    no = rows.column("no").to_numpy()
    place = np.arange(len(no)) - np.searchsorted(no, no)
    return rows.filter(pa.array(place < top)).combine_chunks()
