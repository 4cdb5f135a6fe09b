"""Placement of rows on shards by a permutation-filled lookup table.

Each shard has a preference order over all slots of a prime-sized table (an offset and a step from its name's digest).  Shards
take turns, each claiming the next free slot it prefers, until the table is full; shares differ by one slot at
most.  A key's fingerprint modulo the size is its slot, so placement is one lookup in a table whose size does not
depend on the data; it is joined as a broadcast.  When a shard leaves, nearly all other slots keep their owner.

Defined results: a null key is placed as the empty key; equal keys share a shard; an empty table gives an empty result;
one shard takes all; duplicate shard names are an error.  ``placed`` keeps the input's columns and adds one, whose name must be new.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, functions as F

SLOTS = 65537


def _digest(name: str, salt: str) -> int:
    return int.from_bytes(hashlib.sha256(f"{salt}:{name}".encode()).digest()[:8], "big")


def lookup_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """The index of the owning shard for each slot; ``slots`` is a prime above the number of shards."""
    if len(set(shards)) != len(shards) or not shards:
        raise ValueError("shard names must be given and differ")
    if slots < len(shards) or any(slots % d == 0 for d in range(2, int(slots ** 0.5) + 1)):
        raise ValueError("slots must be a prime not below the number of shards")
    at = [_digest(s, "offset") % slots for s in shards]
    step = [_digest(s, "step") % (slots - 1) + 1 for s in shards]
    owner, free = [-1] * slots, slots
    while True:
        for i in range(len(shards)):
            while owner[at[i]] >= 0:
                at[i] = (at[i] + step[i]) % slots
            owner[at[i]] = i
            free -= 1
            if not free:
                return owner


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """60 bits of the key text's MD5, modulo the table's size."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long") % slots


def placed(df: DataFrame, key: str, shards: list[str], slots: int = SLOTS, name: str = "shard") -> DataFrame:
    """The rows with the name of their shard."""
    if name in df.columns:
        raise ValueError(f"column {name!r} is already there")
    owner = lookup_table(shards, slots)
    table = df.sparkSession.createDataFrame([(i, shards[o]) for i, o in enumerate(owner)], "_slot long, _shard string")
    given = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), slot_of(F.col(f"`{key}`"), slots).alias("_slot"))
    # the table has a fixed number of slots, so its broadcast is bounded
    return given.join(F.broadcast(table), "_slot").select("_row.*", F.col("_shard").alias(name))
