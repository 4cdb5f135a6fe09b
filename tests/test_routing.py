"""Routing through the trie of aliases against trying every span."""

import random
import re

import pytest

from loomtable.operators.concepts import alias_trie, route_questions


def brute(question, aliases):
    words = [w for w in re.split(r"[^a-z0-9]+", (question or "").lower()) if w]
    spans = sorted((-(j - i), i, " ".join(words[i:j])) for i in range(len(words)) for j in range(i + 1, len(words) + 1) if " ".join(words[i:j]) in aliases)
    taken, out = [], []
    for o, i, text in spans:
        if all(i - o <= a or b <= i for a, b in taken):
            taken.append((i, i - o))
            out.append(aliases[text])
    return list(dict.fromkeys(out))


@pytest.mark.parametrize("seed", [1, 2])
def test_walks_find_what_every_span_finds(frame, seed):
    rng = random.Random(seed)
    vocabulary = ["a", "b", "c", "d", "e"]
    aliases = {" ".join(rng.choices(vocabulary, k=rng.choice([1, 1, 2, 2, 3, 5]))): f"c{rng.randint(0, 9)}" for _ in range(25)}
    aliases[" ".join(["a"] * 40)] = "long"
    questions = [(i, " ".join(rng.choices(vocabulary + ["X,", "A"], k=rng.randint(0, 30)))) for i in range(40)] + [(90, None), (91, "?"), (92, "a " * 45)]
    got = {r.question_id: r.concept_ids for r in route_questions(
        frame("question_id int, question string", *questions), frame("concept_id string, alias string", *[(c, a.upper()) for a, c in aliases.items()])).collect()}
    for i, text in questions:
        assert got.get(i, []) == brute(text, aliases), text


def test_trie_steps_are_shared_and_walks_end(frame):
    aliases = frame("concept_id string, alias string", ("x", "hot pump"), ("y", "hot pump seal"), ("z", " Hot "))
    steps = {tuple(r) for r in alias_trie(aliases).select("state", "word", "next_state", "concept_id").collect()}
    assert steps == {("", "hot", "hot", "z"), ("hot", "pump", "hot pump", "x"), ("hot pump", "seal", "hot pump seal", "y")}
    questions = frame("question_id int, question string", (1, "hot pump hot pump seal"), (2, "cold"))
    assert [tuple(r) for r in route_questions(questions, aliases).collect()] == [(1, ["y", "x"])]
    assert route_questions(questions, aliases.limit(0)).collect() == [] and route_questions(questions.limit(0), aliases).collect() == []
