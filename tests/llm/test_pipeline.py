"""The pipeline's result by brute force: which rows stay, their shards, and their order within each."""

import hashlib
import random

import corpus_pipeline
from loomtable.llm.queries import SHARDS
from loomtable.llm.sharding import lookup_table

WEIGHTS = {"src0": 4, "src1": 3, "src2": 2}
BLOCK = 100


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(n))


def brute_mix(rows):
    """(slot, place) of each id: windows of every block by the target weights, earliest deadline first."""
    queue, out, slot = {}, {}, 0
    for i, source in rows:
        queue.setdefault(source, []).append((hashlib.md5(str(i).encode()).hexdigest()[:8], str(i), i))
    queue = {s: [sorted(q)[k:k + BLOCK] for k in range(0, len(q), BLOCK)] for s, q in queue.items()}
    while queue:
        total = sum(WEIGHTS.get(s, 1) for s in queue)
        taken, start = dict.fromkeys(queue, 0), slot
        while all(queue.values()):
            ready = []
            for s in queue:
                w, j = WEIGHTS.get(s, 1), taken[s]
                if j * total // w <= slot - start:
                    due = -(-(j + 1) * total // w)
                    ready.append((due, (j + 1) * total % w == 0, s))
            s = min(ready)[2]
            for place, (*_, i) in enumerate(queue[s].pop(0)):
                out[i] = (slot, place)
            taken[s] += 1
            slot += 1
        queue = {s: q for s, q in queue.items() if q}
    return out


def test_pipeline_by_brute_force(spark, tmp_path):
    rng = random.Random(5)
    item = prose(9999, 30)
    good = [(i, prose(i, 30), "en", rng.choice(["src0", "src0", "src1", "src7", "src8"])) for i in range(1500)]
    gone = [(None, prose(3, 30), "en", "src0"), (None, item, "en", "src1"), (2000, prose(4, 30), "en", "src0"), (2001, item, "en", "src7"), (2002, "few", "en", "src0")]
    rows = good + gone
    rng.shuffle(rows)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    table = lookup_table(SHARDS)
    shard = {i: SHARDS[table[int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16) % 65537]] for i, *_ in good}
    at = brute_mix([(i, s) for i, _, _, s in good])
    assert max(slot for slot, _ in at.values()) > 12
    want = sorted(at, key=lambda i: (shard[i], at[i]))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert [(r.doc_id, r.shard) for r in out.collect()] == [(i, shard[i]) for i in want]
    # files by name hold the shards in turn
    out.write.parquet(f"{tmp_path}/out")
    read = [r.doc_id for f in sorted((tmp_path / "out").glob("part-*.parquet")) for r in spark.read.parquet(str(f)).collect()]
    assert read == want
