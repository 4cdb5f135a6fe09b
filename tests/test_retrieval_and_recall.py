"""Top-k retrieval over blocks and recall with merging statistics, against plain counting."""

import collections
import math
import random
import re

import pytest

from conftest import rows
from loomtable.operators import recall, retrieval
from loomtable.operators.recall import add_memories, merge_recall_statistics, recall_index, recall_situations, recall_statistics
from loomtable.operators.retrieval import node_blocks, retrieve_nodes

NODE = "node_id int, title string, body string, concept_ids array<string>"


@pytest.fixture
def library(frame):
    rng = random.Random(11)
    common, rare = ["the", "of", "and"], [f"w{i}" for i in range(60)]
    text = lambda k: " ".join(rng.choice(common) if rng.random() < 0.4 else rng.choice(rare) for _ in range(k))
    nodes = [(i, text(rng.randint(0, 3)), text(rng.choice([0, 2, 5, 20, 60])), rng.choice([["hot"], ["hot"], ["a"], ["a", "b"], ["b", "hot", "b"], []])) for i in range(300)]
    nodes += [(400, None, "w1 w2", ["a"]), (401, "w1 W2!", None, ["a", None]), (402, "w1", "w2", None)]
    questions = [(i, text(rng.randint(1, 25)) + " W3?") for i in range(12)] + [(50, None), (51, "!"), (52, "nothing here")]
    scope = [(q, c) for q, _ in questions for c in ("hot", "a", "b", "unknown") if rng.random() < 0.7] + [(0, "a"), (0, "a"), (99, "a")]
    return nodes, questions, scope


def brute(nodes, questions, scope, top_k):
    words = lambda t: set(re.findall(r"[a-z0-9]+", (t or "").lower()))
    out = []
    for q, text in questions:
        wanted = {c for s, c in scope if s == q}
        scored = sorted((-len(words(text) & (words(t) | words(b))), n) for n, t, b, cs in nodes if wanted & set(cs or []))
        scored = [(q, n, -s) for s, n in scored if s < 0]
        out += scored[:top_k] if top_k else scored
    return sorted(out)


@pytest.mark.parametrize("block_nodes,top_k", [(1, 3), (8, 5), (8, None), (1000, 500)])
def test_retrieval_in_blocks_equals_scoring_every_node(frame, library, block_nodes, top_k):
    nodes, questions, scope = library
    index = node_blocks(frame(NODE, *nodes), block_nodes)
    got = retrieve_nodes(frame("question_id int, question string", *questions), frame("question_id int, concept_id string", *scope), None, top_k, index)
    assert sorted(tuple(r) for r in got.select("question_id", "node_id", "score").collect()) == brute(nodes, questions, scope, top_k)


def test_retrieval_opens_only_blocks_that_can_win(frame, monkeypatch):
    """Long nodes answer first; blocks of short nodes cannot reach their scores and stay closed."""
    words = [f"w{i}" for i in range(40)]
    nodes = [(i, "", " ".join(words[:30 + i % 3]), ["c"]) for i in range(20)] + [(100 + i, "", " ".join(words[i % 30:i % 30 + 4]), ["c"]) for i in range(2000)]
    opened = []
    scored = retrieval._scored

    def counting(index, wanted, top_k):
        opened.append(wanted.count())
        return scored(index, wanted, top_k)

    monkeypatch.setattr(retrieval, "_scored", counting)
    index = node_blocks(frame(NODE, *nodes), 20)
    got = retrieve_nodes(frame("question_id int, question string", (1, " ".join(words))), frame("question_id int, concept_id string", (1, "c")), None, 5, index)
    assert [(r[1], r[2]) for r in sorted(rows(got), key=lambda r: (-r[2], r[1]))] == [(i, 32) for i in range(2, 15, 3)]
    blocks = index.select("concept_id", "block").distinct().count()
    assert blocks > 80 and sum(opened) <= 5


def test_retrieval_of_nothing(frame, library):
    nodes, questions, scope = library
    q, s, n = frame("question_id int, question string", *questions), frame("question_id int, concept_id string", *scope), frame(NODE, *nodes)
    for args in ((q.limit(0), s, n), (q, s.limit(0), n), (q, s, n.limit(0))):
        assert retrieve_nodes(*args, top_k=3).collect() == [] and retrieve_nodes(*args).collect() == []
    with pytest.raises(ValueError, match="positive"):
        node_blocks(n, 0)


@pytest.mark.parametrize("slots,top_k", [(1 << 14, 4), (1, 4), (1, None)])
def test_an_index_for_known_questions_keeps_their_words_only(frame, library, monkeypatch, slots, top_k):
    """What is written and shuffled is a small part of the texts; words that share a bit change no score."""
    nodes, questions, scope = library
    nodes = [(n, t, f"{b or ''} " + " ".join(f"other{n}x{i}" for i in range(50)), c) for n, t, b, c in nodes]
    written, stored = [], retrieval.stored
    monkeypatch.setattr(retrieval, "SLOTS", slots, raising=False)
    monkeypatch.setattr(retrieval, "PART_WORDS", 100, raising=False)
    monkeypatch.setattr(retrieval, "stored", lambda df: written.append(stored(df)) or written[-1])
    got = retrieve_nodes(frame("question_id int, question string", *questions), frame("question_id int, concept_id string", *scope), frame(NODE, *nodes), top_k)
    assert sorted(tuple(r) for r in got.select("question_id", "node_id", "score").collect()) == brute(nodes, questions, scope, top_k)
    asked = {w for _, t in questions for w in re.findall(r"[a-z0-9]+", (t or "").lower())}
    kept = collections.Counter(w in asked for r in written[0].collect() for w in r.words)
    assert kept[False] < (0.05 if slots > 1 else 1000) * kept[True] and len(written) == 1


def test_blocks_are_looked_up_without_moving_the_index(frame, library):
    nodes, questions, scope = library
    index = node_blocks(frame(NODE, *nodes), 8)
    plan = index._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan


# ---- recall ----

def plain_scores(docs, asked):
    counts = {i: collections.Counter(re.findall(r"\w+", (t or "").lower())) for i, t in docs}
    n, avg = len(docs), sum(sum(c.values()) for c in counts.values()) / len(docs)
    df = collections.Counter(w for c in counts.values() for w in c)
    idf = {w: math.log(n - f + 0.5) - math.log(f + 0.5) for w, f in df.items()}
    eps = 0.25 * sum(idf.values()) / len(idf)
    idf = {w: x if x >= 0 else eps for w, x in idf.items()}
    out = {}
    for s, text in asked:
        q = re.findall(r"\w+", (text or "").lower())
        scores = {i: sum(idf.get(w, 0) * c[w] * 2.5 / (c[w] + 1.5 * (0.25 + 0.75 * sum(c.values()) / avg)) for w in q) for i, c in counts.items()}
        out[s] = sorted(scores.items(), key=lambda x: (-round(x[1], 9), x[0]))
    return out


@pytest.fixture
def memories():
    rng = random.Random(2)
    common, rare = ["the", "of", "and", "in"], [f"w{i}" for i in range(120)]
    text = lambda k: " ".join(rng.choice(common) if rng.random() < 0.5 else rng.choice(rare) for _ in range(k))
    docs = [(i, text(rng.choice([0, 1, 5, 30, 80]))) for i in range(250)] + [(300, None), (301, "the the the"), (302, "w1 w1"), (303, "w1 w1")]
    asked = [(i, text(rng.randint(1, 20))) for i in range(10)] + [(20, None), (21, "unseen"), (22, "the of"), (23, "w1")]
    return docs, asked


def same(got, docs, asked, n):
    want, found = plain_scores(docs, asked), collections.defaultdict(list)
    for r in sorted(got.collect(), key=lambda r: (r.situation_id, r.rank)):
        found[r.situation_id].append(r)
    for s, _ in asked:
        assert [r.memory_id for r in found[s]] == [i for i, _ in want[s][:n]], s
        assert [r.score for r in found[s]] == pytest.approx([x for _, x in want[s][:n]])


@pytest.mark.parametrize("n,seeds,part", [(1, 200, 1 << 20), (3, 1, 16), (40, 5, 50)])
def test_recall_equals_scoring_every_memory(frame, memories, monkeypatch, n, seeds, part):
    monkeypatch.setattr(recall, "SEEDS", seeds)
    monkeypatch.setattr(recall, "PART", part)
    docs, asked = memories
    same(recall_situations(frame("memory_id int, text string", *docs), frame("situation_id int, text string", *asked), n), docs, asked, n)


def test_batches_grow_without_reading_old_memories(frame, memories):
    docs, asked = memories
    schema, situations = "memory_id int, text string", frame("situation_id int, text string", *asked)
    index = recall_index(frame(schema, *docs[:90]))
    statistics = recall_statistics(index)
    for part in (docs[90:91], docs[91:], []):
        index, statistics = add_memories(index, statistics, frame(schema, *part) if part else frame(schema, *docs[:1]).limit(0))
    assert sorted(map(tuple, statistics.collect()), key=str) == sorted(map(tuple, recall_statistics(recall_index(frame(schema, *docs))).collect()), key=str)
    same(recall_situations(None, situations, 3, index, statistics), docs, asked, 3)
    twice = merge_recall_statistics(statistics, statistics).filter("term is null").first()
    assert twice["memories"] == 2 * len(docs)


def test_recall_over_no_memories(frame, memories):
    none = frame("memory_id int, text string", (1, "x")).limit(0)
    assert recall_situations(none, frame("situation_id int, text string", *memories[1]), 2).collect() == []


def test_parts_of_a_recall_index_grow_in_number_and_not_in_size(frame, monkeypatch):
    from collections import Counter

    from loomtable.operators import recall

    monkeypatch.setattr(recall, "PART_CHARS", 40)
    texts = {i: " ".join(f"w{(i * k) % 7}" for k in range(i % 12)) for i in range(60)} | {60: None, 61: " ,;"}
    index = recall.recall_index(frame("memory_id bigint, text string", *texts.items()))
    assert index.rdd.getNumPartitions() >= sum(len(t or "") for t in texts.values()) // 40
    got = {(r.memory_id, r.term): (r.dl, r.tf) for r in index.collect()}
    want = {(i, w): (len((t or " ").replace(",;", "").split()), n) for i, t in texts.items() for w, n in Counter((t or "").replace(",;", "").split()).items()}
    want |= {(i, None): (len((t or "").replace(",;", "").split()), 0) for i, t in texts.items()}
    assert got == want and index.count() == len(want)
