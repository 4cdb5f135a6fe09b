"""Benchmark passages in documents: SimHash of item-sized windows, looked up by Hamming blocks, then verified.

A window is as many words as the item has, at any word of a document (the whole document if that is
shorter).  Its weighted shingles are its runs of five folded words with the number of times each
occurs; its fingerprint is the 64-bit SimHash of these.  Items of one size share a multi-index: the fingerprint is cut into 8
blocks of 8 bits, and an item is found if any block is within 2 bits, so every fingerprint within distance 23 is
found for certain.  A window of similarity 0.8 lies within that radius with probability above 0.99999.  Found
pairs are verified by exact weighted Jaccard similarity (sum of minima over sum of maxima).

Windows that share no shingle with the items have similarity 0 and are never fingerprinted; that test is one pass over
the texts.  The items are the query set: they are read in blocks of bounded bytes, each block one pass over the
documents with a broadcast index, so memory does not grow with the benchmark.

Defined results: null and empty texts and items match nothing; an item of one to four words matches where the same run of
words occurs; of windows of equal similarity the first is returned; rows are scanned one by one, so repeated rows each
give their hits; empty tables give an empty result.  Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from loomtable.llm.tables import columns, written
from loomtable.llm.words import SHINGLE, Words, batches_of_bytes, mixed

BLOCKS, NEAR, RADIUS = 8, 2, 23
_BITS = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def _signs(shingles: np.ndarray) -> np.ndarray:
    """One row of +1 / -1 for each shingle, 64 columns."""
    bits = np.unpackbits(mixed(shingles).view(np.uint8).reshape(-1, 8), axis=1)
    return bits.astype(np.int32) * 2 - 1


def fingerprints(sums: np.ndarray) -> np.ndarray:
    """SimHash bytes, 8 for each row of sums."""
    return np.packbits(sums > 0, axis=1)


class Index:
    """The items of one block."""

    def __init__(self, items: list[tuple[object, bytes]]):
        words = Words([t for _, t in items])
        shingles, first = words.shingles()
        self.ids = [i for i, _ in items]
        self.size = np.diff(words.first)
        self.members = [np.sort(shingles[a:b]) for a, b in zip(first[:-1], first[1:])]
        owner = np.repeat(np.arange(len(items)), np.diff(first))
        full = self.size[owner] >= SHINGLE
        order = np.argsort(shingles[full], kind="stable")
        self.shingles, self.owner = shingles[full][order], owner[full][order]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.shingles >> np.uint64(44)).astype(np.int64)] = True
        self.prints, self.tables = {}, {}
        for n in set(self.size[self.size >= SHINGLE].tolist()):
            own = np.flatnonzero(self.size == n)
            prints = np.concatenate([fingerprints(_signs(self.members[i]).sum(0, keepdims=True)) for i in own])
            near = [[own[_BITS[prints[:, b] ^ v] <= NEAR] for v in range(256)] for b in range(BLOCKS)]
            self.prints.update(zip(own.tolist(), prints))
            self.tables[n] = near
        self.same = {}
        for i in np.flatnonzero((self.size > 0) & (self.size < SHINGLE)):
            n = int(self.size[i])
            runs, at = words.shingles(n)
            self.same.setdefault((n, int(runs[at[i]])), []).append(int(i))

    def hits(self, texts: list[bytes]) -> Iterator[tuple[int, int, int, int, float]]:
        """(text, item, first word, words, similarity)."""
        words = Words(texts)
        shingles, first = words.shingles()
        counts = np.diff(words.first)
        there = np.flatnonzero(self.maybe[(shingles >> np.uint64(44)).astype(np.int64)])
        if len(self.shingles):
            at = np.searchsorted(self.shingles, shingles[there])
            there = there[self.shingles[np.minimum(at, len(self.shingles) - 1)] == shingles[there]]
        text_of = np.searchsorted(first, there, side="right") - 1
        for d in np.unique(text_of):
            if counts[d] >= SHINGLE:
                own = shingles[first[d]:first[d + 1]]
                yield from ((int(d), *hit) for hit in self._in_text(own, there[text_of == d] - first[d], int(counts[d])))
        for n in {n for n, _ in self.same}:
            runs, at = words.shingles(n)
            wanted = np.array([h for m, h in self.same if m == n], np.uint64)
            seen = set()
            for j in np.flatnonzero(np.isin(runs, wanted)):
                d = int(np.searchsorted(at, j, side="right") - 1)
                if counts[d] >= n and (d, runs[j]) not in seen:
                    seen.add((d, runs[j]))
                    for i in self.same[n, int(runs[j])]:
                        yield d, i, int(j - at[d]), n, 1.0

    def _in_text(self, own: np.ndarray, shared: np.ndarray, n_words: int) -> Iterator[tuple[int, int, int, float]]:
        spans: dict[int, list[tuple[int, int]]] = {}
        for j in shared:
            a, b = np.searchsorted(self.shingles, own[j], "left"), np.searchsorted(self.shingles, own[j], "right")
            for n in set(self.size[self.owner[a:b]].tolist()):
                spans.setdefault(n, []).append((max(0, j + SHINGLE - n), min(int(j), max(0, n_words - n))))
        for n, ranges in spans.items():
            starts = np.unique(np.concatenate([np.arange(a, b + 1) for a, b in ranges]))
            width = min(n, n_words) - SHINGLE + 1
            used = np.unique(np.concatenate([np.arange(a, min(b + width, len(own))) for a, b in ranges]))
            # signs only where a window lies; windows never leave the used runs
            sums = np.zeros((len(used) + 1, 64), np.int32)
            np.cumsum(_signs(own[used]), axis=0, out=sums[1:])
            at = np.searchsorted(used, starts)
            prints = fingerprints(sums[at + width] - sums[at])
            best: dict[int, tuple[float, int]] = {}
            for start, mark in zip(starts.tolist(), prints):
                found = np.unique(np.concatenate([self.tables[n][b][mark[b]] for b in range(BLOCKS)]))
                window = None
                for i in found.tolist():
                    if _BITS[self.prints[i] ^ mark].sum() > RADIUS:
                        continue
                    window = np.sort(own[start:start + width]) if window is None else window
                    similarity = weighted_jaccard(window, self.members[i])
                    if similarity > best.get(i, (0.0, 0))[0]:
                        best[i] = (similarity, start)
            for i, (similarity, start) in best.items():
                yield i, start, min(n, n_words), similarity


def weighted_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted arrays with repeats."""
    x, n = np.unique(a, return_counts=True)
    y, m = np.unique(b, return_counts=True)
    common, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    low = int(np.minimum(n[i], m[j]).sum())
    return low / (len(a) + len(b) - low)


def item_blocks(benchmark: DataFrame, most_bytes: int) -> Iterator[list[tuple[object, bytes]]]:
    block, size = [], 0
    for row in benchmark.select("id", "text").toLocalIterator():
        text = (row.text or "").encode()
        if block and size + len(text) > most_bytes:
            yield block
            block, size = [], 0
        block.append((row.id, text))
        size += len(text)
    if block:
        yield block


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                   item_text_col: str = "text", similarity: float = 0.8, block_bytes: int = 4 << 20) -> DataFrame:
    """id, item_id, first_word, n_words, similarity: the best window of each item that a document holds."""
    given, items = columns(docs, id=id_col, text=text_col), columns(benchmark, id=item_col, text=item_text_col)
    kinds = {"id": given.schema["id"].dataType.simpleString(), "item": items.schema["id"].dataType.simpleString()}
    schema = f"id {kinds['id']}, item {kinds['item']}, first_word long, n_words long, similarity double"
    context, out = docs.sparkSession.sparkContext, None
    for block in item_blocks(items, block_bytes):
        shared = context.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = Index(shared.value)
            for batch in batches:
                for at, texts in batches_of_bytes(batch.column(1)):
                    found = [h for h in index.hits(texts) if h[4] >= similarity]
                    where = pa.array([at + h[0] for h in found], pa.int64())
                    yield pa.record_batch([
                        batch.column(0).take(where), pa.array([index.ids[h[1]] for h in found], item_type),
                        pa.array([h[2] for h in found], pa.int64()), pa.array([h[3] for h in found], pa.int64()),
                        pa.array([h[4] for h in found], pa.float64())], names=["id", "item", "first_word", "n_words", "similarity"])

        item_type = pa.int64() if kinds["item"] == "bigint" else pa.int32() if kinds["item"] == "int" else pa.string()
        found = given.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = docs.sparkSession.createDataFrame([], schema)
    return out.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "first_word", "n_words", "similarity")


def without_benchmark(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **names) -> DataFrame:
    """The documents that hold no item.  The ids that go are written once; a null id never leaves."""
    bad = written(benchmark_hits(docs, benchmark, id_col, **names).select(F.col(id_col).alias("_leak_id")).distinct())
    return docs.join(bad, F.col(f"`{id_col}`") == F.col("_leak_id"), "left_anti")


def rows_without_benchmark(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
                           item_text_col: str = "text", similarity: float = 0.8, block_bytes: int = 4 << 20) -> DataFrame:
    """The rows that hold no item, each decided by its own text, whatever its id: whole rows pass one map per block of items."""
    items, at_text = columns(benchmark, id=item_col, text=item_text_col), docs.columns.index(text_col)
    context, out = docs.sparkSession.sparkContext, docs
    for block in item_blocks(items, block_bytes):
        shared = context.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = Index(shared.value)
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for at, texts in batches_of_bytes(batch.column(at_text)):
                    clean[[at + h[0] for h in index.hits(texts) if h[4] >= similarity]] = False
                yield batch.filter(pa.array(clean))
                pa.default_memory_pool().release_unused()

        out = out.mapInArrow(run, docs.schema)
    return out
