"""Ranked search, pieces and the filter audit against plain Python and the library."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest

from loomtable.llm.pieces import Pieces, decoded, encoded, read_model
from loomtable.llm.queries import QUERIES
from loomtable.llm.ranked_scan import best_documents
from loomtable.llm.survival import filter_audit, positional_popcount

public_tokenizers = pytest.importorskip("public_tokenizers")
MODEL = public_tokenizers.path("piece_bpe_32k.model")


def folded_terms(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def brute_ranks(docs, items, top):
    """{(item place): [(doc_id, score)]} by counting every document."""
    words = [(i, folded_terms(t)) for i, t in docs]
    n_docs, n_terms = sum(bool(w) for _, w in words), sum(len(w) for _, w in words)
    df = Counter(t for _, w in words for t in set(w))
    out = []
    for item, text in items:
        scores = []
        for i, w in words:
            tf, m = Counter(w), 75 + (25 * len(w) * n_docs) // max(n_terms, 1)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * tf[t]) // (1000 * tf[t] + 12 * m))
                    for t in folded_terms(text) if tf[t])
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out.append((item, [(i, -s) for s, _, _, i in sorted(scores, key=lambda x: x[:3])[:top]]))
    return out


def found_ranks(df):
    got = defaultdict(list)
    for r in df.orderBy("item_id", "rank").collect():
        got[r["item_id"]].append((r["rank"], r["doc_id"], r["score"]))
    return got


@pytest.mark.parametrize("block_bytes", [1 << 20, 40])
def test_ranked_documents_equal_counting(spark, block_bytes):
    rng = random.Random(5)
    vocabulary = ["the", "The", "of", "éa", "日本", "x1", "a", "aa", "aaa", "b-c", "d_e", "zz"]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 30)))) for i in range(120)]
    docs += [(200, None), (201, ""), (202, "!?"), (203, "the " * 5000 + "aa"), (None, "aa aaa"), (204, "aa.aaa\n日本-of"), (7, "zz zz"), (205, "\x00the\x00\x00aa\x7fzz")]
    items = [(0, "The of aa"), (1, "zz zz x1 nowhere"), (2, None), (3, ""), (4, "aaa 日本 éa b c"), (5, "nowhere")]
    frame = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in docs], "doc_id long, text string, item_id string, score string, rank int").repartition(7)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = found_ranks(best_documents(frame, bench, top=20, block_bytes=block_bytes))
    for item, want in brute_ranks(docs, items, 20):
        assert got.get(item, []) == [(k + 1, i, s) for k, (i, s) in enumerate(want)], item


def test_ranked_documents_ties_repeats_and_empty(spark):
    docs = spark.createDataFrame([(i, "same words here") for i in range(300, 0, -1)] + [(1000, "other text")], "doc_id long, text string").repartition(9)
    bench = spark.createDataFrame([(1, "same here"), (1, "same here"), (2, "text")], "item_id long, text string")
    rows = best_documents(docs, bench, top=20).collect()
    assert Counter((r["item_id"], r["rank"], r["doc_id"]) for r in rows if r["item_id"] == 1) == {(1, k, k): 2 for k in range(1, 21)}
    assert [(r["rank"], r["doc_id"]) for r in rows if r["item_id"] == 2] == [(1, 1000)]
    assert best_documents(docs.limit(0), bench).collect() == []
    assert best_documents(docs, bench.limit(0)).collect() == []
    names = spark.createDataFrame([("b", "same"), ("a", "same"), (None, "same")], "doc_id string, text string")
    more = names.union(spark.createDataFrame([("z", "not that")], "doc_id string, text string"))
    texts = best_documents(more, spark.createDataFrame([("i", "same")], "item_id string, text string")).collect()
    assert [(r["item_id"], r["rank"], r["doc_id"]) for r in texts] == [("i", 1, "a"), ("i", 2, "b"), ("i", 3, None)]


def odd_texts():
    rng = random.Random(3)
    out = ["", " ", "  ", "▁", "▁a ▁", "\x00", "日本語テキスト", "🙂🙂x", "<s> </s> <0x0A> <unk>", "\n\n \n", " a  b   c    d", "é" * 50, "�", "á"]
    for n in range(1, 40):
        out += [" " * n + "the", "the" + " " * n, "x" + " " * n + "y", " " * n + "\n", "a" * n, "ab" * n]
    alphabet = "abcdeé 🙂\n▁日the in of ingertion\t"
    out += ["".join(rng.choices(alphabet, k=rng.randint(1, 60))) for _ in range(800)]
    return out


def test_pieces_equal_the_library():
    sentencepiece = pytest.importorskip("sentencepiece")
    lib, own = sentencepiece.SentencePieceProcessor(model_file=MODEL), Pieces(read_model(MODEL))
    assert own.run == 16
    rng, vocabulary = random.Random(4), [lib.id_to_piece(i).replace("▁", " ") for i in range(259, lib.get_piece_size())]
    texts = odd_texts() + ["".join(rng.choices(vocabulary, k=rng.randint(1, 12))) for _ in range(1500)]
    texts += ["".join(rng.choices(vocabulary[:500], k=rng.randint(1, 12))).replace(" ", "") for _ in range(1500)]
    texts += [" " * 50000, "a" * 20000, "".join(rng.choices("abcdefXYZ0189+/", k=30000))]
    ids, first = own.encode([t.encode() for t in texts])
    want = lib.encode(texts, add_bos=True, add_eos=True, num_threads=1)
    assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:])] == want
    assert own.decode(ids.astype(np.int64), first) == [lib.decode(w) for w in want]


def test_pieces_of_a_vocabulary_without_even_runs():
    """Without the cut of long runs, and with every pair forced to merge alone, the ids are the same."""
    model = read_model(MODEL)
    texts = [t.encode() for t in odd_texts()]
    want = Pieces(model).encode(texts)
    slow = Pieces(model)
    slow.run, slow.comes_early = 0, np.ones_like(slow.comes_early)
    got = slow.encode(texts)
    assert got[0].tolist() == want[0].tolist() and got[1].tolist() == want[1].tolist()


def test_pieces_frames(spark):
    lib = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=MODEL)
    rows = [(1, "Hello  world"), (2, None), (2, ""), (None, "日本 x"), (4, "a b " * 30000)]
    frame = spark.createDataFrame([(i, t, "q", 5) for i, t in rows], "doc_id long, text string, ids string, n_tokens int").repartition(3)
    out = decoded(encoded(frame, MODEL), MODEL, ["doc_id", "n_tokens"]).collect()
    want = [(i, lib.encode(t or "", add_bos=True, add_eos=True)) for i, t in rows]
    assert Counter((r["doc_id"], r["n_tokens"], bytes(r["ids"]), r["decoded"]) for r in out) == Counter(
        (i, len(w), np.array(w, "<u4").tobytes(), lib.decode(w)) for i, w in want)
    assert encoded(frame.limit(0), MODEL).collect() == []
    with pytest.raises(Exception, match="vocabulary"):
        decoded(spark.createDataFrame([(1, bytearray(b"\xff\xff\xff\x00"))], "doc_id int, ids binary"), MODEL, ["doc_id"]).collect()


def test_pieces_query_equals_the_library(spark):
    lib = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=MODEL)
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    ids = {r["doc_id"]: lib.encode(r["text"] or "", add_bos=True, add_eos=True) for r in docs}
    want = {i: (len(w), hashlib.sha256(np.array(w, "<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(w).encode()).hexdigest())
            for i, w in ids.items()}
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in QUERIES["op12_piece_ids"](spark, sf).collect()}
    assert got == want


def test_popcount_counts_bits():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 4, 100, 1000):
        words = rng.integers(0, 1 << 32, n, dtype=np.uint32)
        assert positional_popcount(words).tolist() == [int(((words >> np.uint32(b)) & 1).sum()) for b in range(32)]


def brute_audit(docs, labels):
    good, toxic = {i for i, q, _ in labels if q == 1} - {None}, {i for i, _, x in labels if x == 1} - {None}
    parts = defaultdict(list)
    for i, text, part in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
                 "D": bool(re.search(r"[#$%&*|]", t)),
                 "E": i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs)}
        parts[part or ""].append((i, {f for f, x in fails.items() if x}))
    out = {}
    for part, rows in parts.items():
        share = Counter()
        for order in permutations("ABCDE"):
            left = rows
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                share[f] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(f in x for _, x in rows) - len(gone), sum(x == {f} for _, x in rows),
                    sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
        for (p, order, step), figures in out.items():
            if p == part:
                figures.append(share[order[step - 1]])
    return out


def test_filter_audit_equals_walking_every_order(spark):
    rng = random.Random(9)
    vocabulary = ["alpha", "Beta", "GAMMA", "d#", "e", "f", "été", "a|b"] + [f"w{i}" for i in range(80)]
    docs = []
    for i in range(60):
        k = rng.choice([0, 3, 49, 50, 60, 90])
        docs.append((i, " ".join(rng.choices(vocabulary, k=k) if rng.random() < 0.6 else [f"w{j}" for j in range(k)]), rng.choice(["s1", "s2", None, ""])))
    docs += [(100, docs[5][1], "s1"), (3, docs[5][1], "s2"), (None, docs[5][1], "s1"), (101, None, "s3"), (102, "", "s3"), (102, "", "s3"),
             (104, "x" * 300_000 + " \t\x0b" + "y ", None), (-1, " A B", "s1")]
    labels = [(i, rng.randint(0, 1), rng.randint(0, 1)) for i in range(0, 70, 2)] + [(2, 1, 0), (None, 1, 1), (5, None, 1), (999, 1, 1)]
    frame = spark.createDataFrame([(i, t, p, 0, "k") for i, t, p in docs], "doc_id long, text string, source string, good int, digest string").repartition(5)
    said = spark.createDataFrame([(*x, "z") for x in labels], "doc_id long, quality int, toxic int, part string")
    got = {(r["part"], r["filter_order"], r["step"]): [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")]
           for r in filter_audit(frame, said).collect()}
    assert got == brute_audit(docs, labels)
    assert filter_audit(frame.limit(0), said).collect() == []
    assert filter_audit(frame, said.limit(0)).agg({"good_lost": "sum"}).first()[0] == 0
