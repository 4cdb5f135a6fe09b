"""Near-duplicate documents by min-max hashing.

Each permutation of a document's shingle fingerprints gives two signature values, its minimum and its
maximum, so half the hash evaluations of plain MinHash give the same signature.  Bands of the signature
are bucket keys.  With the defaults (32 bands of 6 values, 96 permutations) a pair of similarity 0.85 meets in
no bucket with probability 3e-7, one of 0.9 with 4e-11; texts that only share a boilerplate line rarely meet.

Steps: texts with the same shingle set collapse into one class by a pre-aggregated group; only class
representatives are banded.  In a bucket every member is compared with a few leaders, not with every
other member; the links found join components; members that are in other components than the rest of
their bucket are compared with further leaders as long as that joins components.  The members of buckets still
split are then paired exactly by prefix filtering: under one order of all shingles, frequent ones last, two sets of the wanted
similarity share one of their first few; pairs of one component are left out.  So no bucket has a cap, and texts that share a
frequent passage but little else are never paired.  Links are confirmed on the full sets.

Defined results: a null id is kept as a document of its own that links with nothing; rows that repeat an id
are one document with a row each in the result (of its different texts, the one whose set has the smallest fingerprint counts); empty texts have
n_shingles 0 and link with nothing; an empty table gives an empty result.  Extra columns are not read.  ``one_of_each`` decides
by row, not by id: rows without an id and rows that repeat one are documents like any other.
"""

from __future__ import annotations

import hashlib
import operator
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from loomtable.llm.components import connected
from loomtable.llm.tables import columns, possibly_among, row_keyed, written
from loomtable.llm.words import Words, batches_of_bytes, mixed


def _signatures(bands: int, rows: int, seed: int = 7):
    perms = (bands * rows + 1) // 2
    factors = np.random.default_rng(seed).integers(0, 1 << 63, perms, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def per_chunk(sets: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Band keys, one row for each text; all texts of the chunk have shingles."""
        values = np.empty((2 * perms, len(first) - 1), np.uint64)
        for k in range(perms):
            x = sets * factors[k]
            x ^= x >> np.uint64(32)
            values[2 * k] = np.minimum.reduceat(x, first[:-1])
            values[2 * k + 1] = np.maximum.reduceat(x, first[:-1])
        keys = np.zeros((bands, len(first) - 1), np.uint64)
        for b in range(bands):
            for r in range(rows):
                keys[b] = mixed(keys[b] ^ values[b * rows + r]) + np.uint64(b + 1)
        return keys.T

    return per_chunk


def _sets(texts: list[bytes]) -> list[np.ndarray]:
    shingles, first = Words(texts).shingles()
    return [np.unique(shingles[a:b]) for a, b in zip(first[:-1], first[1:])]


def _digest(members: np.ndarray) -> bytes:
    return hashlib.blake2b(members, digest_size=16).digest()


def signed(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """id, n_shingles, set_id (fingerprint of the whole set, 128 bits), keys (one long for each band)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys_of = _signatures(bands, rows)
        for batch in batches:
            for at, texts in batches_of_bytes(batch.column(1)):
                sets = _sets(texts)
                size = np.array([len(s) for s in sets], np.int64)
                full = np.flatnonzero(size)
                digest, keys = [b""] * len(sets), [[]] * len(sets)
                if len(full):
                    flat = np.concatenate([sets[i] for i in full])
                    first = np.concatenate([[0], np.cumsum(size[full])])
                    band = keys_of(flat, first).view(np.int64)
                    for j, i in enumerate(full):
                        digest[i], keys[i] = _digest(sets[i]), band[j]
                yield pa.record_batch([batch.column(0).slice(at, len(texts)), pa.array(size),
                                       pa.array(digest, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                                      names=["id", "n_shingles", "set_id", "keys"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "text").mapInArrow(run, f"id {kind}, n_shingles long, set_id binary, keys array<long>")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """id, set_id, members: the sorted 64-bit fingerprints of a text's shingles, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in batches_of_bytes(batch.column(1)):
                sets = _sets(texts)
                yield pa.record_batch([batch.column(0).slice(at, len(texts)), pa.array([_digest(s) for s in sets], pa.binary()),
                                       pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "set_id", "members"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "text").mapInArrow(run, f"id {kind}, set_id binary, members binary")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets reach the similarity: a, b."""
    both = (pairs.join(sets.select(F.col("id").alias("a"), F.col("members").alias("set_a")), "a")
            .join(sets.select(F.col("id").alias("b"), F.col("members").alias("set_b")), "b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i in range(batch.num_rows):
                x = np.frombuffer(batch.column(2)[i].as_buffer(), np.uint64)
                y = np.frombuffer(batch.column(3)[i].as_buffer(), np.uint64)
                z = np.concatenate([x, y])
                z.sort()
                common = int((z[1:] == z[:-1]).sum())
                keep.append(100 * common >= percent * (len(z) - common))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    kind = pairs.schema["a"].dataType.simpleString()
    return both.select("a", "b", "set_a", "set_b").mapInArrow(run, f"a {kind}, b {kind}")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80,
                    bands: int = 32, rows: int = 6) -> DataFrame:
    """One row per document: id, n_shingles, component_id (smallest id reachable over links), kept."""
    given = columns(docs, id=id_col, text=text_col)
    signs = written(signed(given, bands, rows)).withColumn("order", F.xxhash64("set_id"))
    one_each = signs.filter("id is not null").groupBy("id").agg(
        F.min(F.struct("order", "set_id", "n_shingles")).alias("s")).select("id", "s.set_id", "s.n_shingles")
    full = one_each.filter("n_shingles > 0")
    classes = written(full.groupBy("set_id").agg(F.min("id").alias("rep"), F.min("n_shingles").alias("size")))
    labels = _linked(given, signs, classes, percent)
    sets = classes.join(labels, "rep", "left").select("set_id", F.coalesce("comp", "rep").alias("component_id"))
    placed = full.join(sets, "set_id").select("id", "n_shingles", "component_id")
    rest = one_each.filter("n_shingles = 0").select("id", "n_shingles", F.col("id").alias("component_id"))
    lone = signs.filter("id is null").select("id", "n_shingles", F.col("id").alias("component_id"))
    return (placed.unionByName(rest).unionByName(lone)
            .select(F.col("id").alias(id_col), "n_shingles", "component_id",
                    F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept")))


def _linked(given: DataFrame, signs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """rep, comp for the class representatives that have a link."""
    reps = classes.select("rep", "set_id", "size").join(
        signs.select(F.col("id").alias("rep"), "set_id", "keys"), ["rep", "set_id"])
    keyed = reps.select("rep", "set_id", "size", F.explode("keys").alias("key"))
    busy = keyed.groupBy("key").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).filter("lo < hi").select("key")
    held = written(keyed.join(busy, "key").distinct())
    member = held.select("key", "rep", "size")
    chosen = written(held.select(F.col("rep").alias("id"), "set_id").distinct())
    wanted = possibly_among(given, "id", chosen, "id").join(chosen, "id", "left_semi")
    sets = written(shingle_sets(wanted).join(chosen, ["id", "set_id"]).select("id", "members"))
    links = None
    labels = member.select("rep").distinct().limit(0).select("rep", F.col("rep").alias("comp"))
    tested, turn, before = None, 0, float("inf")
    while True:
        state = written(member.join(labels, "rep", "left").withColumn("comp", F.coalesce("comp", "rep")))
        sizes = written(state.groupBy("key", "comp").agg(F.count("*").alias("c")).groupBy("key")
                        .agg(F.sum("c").alias("n"), F.sum(F.col("c").cast("double") * F.col("c")).alias("squares"))
                        .filter("n * n > squares"))
        totals = sizes.agg(F.sum((F.col("n").cast("double") * F.col("n") - F.col("squares")) / 2).alias("pairs"),
                           F.sum("n").alias("members")).first()
        if not totals.members:
            break
        left = state.join(sizes.select("key"), "key")
        last = turn > 0 and (totals.pairs <= 64 * totals.members or totals.pairs > 0.7 * before)
        before = totals.pairs
        if last:
            pairs = _sharing_rare(left.select("rep", "size", "comp").distinct(), sets, percent)
        else:
            pairs = _with_leaders(left, turn)
        pairs = pairs.filter(F.least("sa", "sb") * 100 >= F.greatest("sa", "sb") * percent).select("a", "b").distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = written(pairs)
        tested = pairs if tested is None else tested.unionByName(pairs)
        found = written(_confirmed(pairs, sets, percent))
        links = found if links is None else links.unionByName(found)
        labels = connected(links, "a", "b").select(F.col("id").alias("rep"), "comp")
        turn += 1
        if last:
            break
    return labels


def _sharing_rare(open_reps: DataFrame, sets: DataFrame, percent: int, sample: int = 1000) -> DataFrame:
    """Pairs across components that share a shingle among each one's first |S| - ceil(percent |S| / 100) + 1.

    A pair must also pass its parity bitmaps (each element flips one of 2048 bits): the bits in which they differ are never more
    than the elements in which the sets differ, so no pair of the wanted similarity fails.
    Any one order is exact.  This one puts shingles of at least a hundredth of a bounded sample last, which keeps groups small;
    that list has at most 100 times the mean set size."""
    held = written(open_reps.join(sets, open_reps.rep == sets.id).select("rep", "size", "comp", "members"))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for m in batch.column(0):
                yield pa.record_batch([pa.array(np.frombuffer(m.as_buffer(), np.int64))], names=["s"])

    some = held.orderBy(F.xxhash64("rep"), "rep").limit(sample).select("members").mapInArrow(listed, "s long")
    often = [r.s for r in some.groupBy("s").count().filter(F.col("count") * 100 >= sample).select("s").collect()]
    shared = open_reps.sparkSession.sparkContext.broadcast(np.sort(np.array(often, np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = shared.value
        for batch in batches:
            first, parity = [], []
            for m in batch.column(3):
                own = np.frombuffer(m.as_buffer(), np.int64)
                rare = own[~np.isin(own, hot)] if len(hot) else own
                place = (own.view(np.uint64) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(53)).astype(np.int64)
                parity.append(np.packbits((np.bincount(place, minlength=2048) & 1).astype(np.uint8)).view(np.int64))
                n = len(own) - -(-percent * len(own) // 100) + 1
                first.append(rare[:n] if len(rare) >= n else np.concatenate([rare, own[np.isin(own, hot)][:n - len(rare)]]))
            yield pa.record_batch([*batch.columns[:3], pa.array(first, pa.list_(pa.int64())), pa.array(parity, pa.list_(pa.int64()))],
                                  names=["rep", "size", "comp", "first", "parity"])

    kind = open_reps.schema["rep"].dataType.simpleString()
    prefix = written(held.mapInArrow(run, f"rep {kind}, size long, comp {kind}, first array<long>, parity array<long>")
                     .select("rep", "size", "comp", "parity", F.explode("first").alias("s")))
    split = prefix.groupBy("s").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("s")
    x = written(prefix.join(split, "s"))
    a, b = x.alias("a"), x.alias("b")
    apart = reduce(operator.add, [F.bit_count(F.get("a.parity", F.lit(i)).bitwiseXOR(F.get("b.parity", F.lit(i)))) for i in range(32)])
    return a.join(b, (F.col("a.s") == F.col("b.s")) & (F.col("a.rep") < F.col("b.rep")) & (F.col("a.comp") != F.col("b.comp"))
                  & (apart * (100 + percent) <= (F.col("a.size") + F.col("b.size")) * (100 - percent))
                  & (F.least("a.size", "b.size") * 100 >= F.greatest("a.size", "b.size") * percent)).select(
        F.col("a.rep").alias("a"), F.col("b.rep").alias("b"), F.col("a.size").alias("sa"), F.col("b.size").alias("sb"))


def _with_leaders(left: DataFrame, turn: int) -> DataFrame:
    """Pairs (leader, member) across components: one more leader per bucket in the first round, then twice as many each time."""
    count = 1 << min(turn, 4)
    picks = [F.min(F.struct(F.xxhash64("rep", F.lit(turn * 100 + s)) if turn else F.col("rep").alias("h"), "rep", "comp", "size")).alias(f"l{s}")
             for s in range(count)]
    leaders = left.groupBy("key").agg(*picks).select(
        "key", F.explode(F.array_distinct(F.array(*[
            F.struct(F.col(f"l{s}.rep").alias("rep"), F.col(f"l{s}.comp").alias("comp"), F.col(f"l{s}.size").alias("size"))
            for s in range(count)]))).alias("lead"))
    return (left.join(leaders, "key").filter((F.col("rep") != F.col("lead.rep")) & (F.col("comp") != F.col("lead.comp")))
            .select(F.least("rep", "lead.rep").alias("a"), F.greatest("rep", "lead.rep").alias("b"),
                    F.col("size").alias("sa"), F.col("lead.size").alias("sb")))



def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows with their own columns, without near-duplicates of an earlier row: one of a smaller id (a null id comes last), of
    equal ids one whose text has the smaller fingerprint."""
    rows = row_keyed(docs, id_col, text_col)
    gone = written(near_duplicates(rows, "_row_key", text_col, **options).filter("not kept").select(F.col("_row_key").alias("_gone")))
    return rows.join(gone, F.col("_row_key") == F.col("_gone"), "left_anti").drop("_row_key")
