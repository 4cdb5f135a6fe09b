"""The operators on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import random
from collections import Counter
from fractions import Fraction

import pytest

from loomtable.llm.archives import (arc_archives, arc_block, arc_record, converted, converted_archives, parsed_arc, read_archives,
                                    warc_records)
from loomtable.llm.chat import digests, escaped, formatted, parsed, rendered, unescaped
from loomtable.llm.decontaminate import benchmark_hits, rows_without_benchmark, without_benchmark
from loomtable.llm.grouping_sort import suffix_array
from loomtable.llm.line_runs import repeated_lines, suffix_ranks, without_repeated_runs, _documents
from loomtable.llm.minhash import near_duplicates, one_of_each
from loomtable.llm.mixing import mixed, mixed_order, one_period, phases, shares, whole_weights
from loomtable.llm.quality import scored, train
from loomtable.llm.queries import QUERIES
from loomtable.llm.repeats import without_repeats
from loomtable.llm.rules import passing, quality_rules
from loomtable.llm.sharding import lookup_table, placed
from loomtable.llm.tables import scratch
from loomtable.llm.words import Words

DOCS = "doc_id long, text string, lang string, source string, id string, row string, no int, keys int"


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(n))


@pytest.fixture
def docs(spark):
    """Documents with columns whose names the operators use inside."""
    def make(*rows):
        full = [(i, t, "en", "s", "x", "y", 1, 2) for i, t in rows]
        return spark.createDataFrame(full, DOCS)
    return make


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


# ---- words ----

def test_words_and_shingles():
    texts = [b"", b"  One two\tTHREE\nfour five six ", b"x", b"one TWO three four five SIX", b"a b c d"]
    w = Words(texts)
    s, first = w.shingles()
    assert list(first) == [0, 0, 2, 3, 5, 6]
    assert list(s[0:2]) == list(s[3:5]) and len(set(s.tolist())) == 4
    assert len(Words([b"A a"]).hash) == 2 and len(set(Words([b"A a"], fold=False).hash.tolist())) == 2


# ---- 1 quality ----

def test_quality_learns_and_defines_edges(spark, docs):
    rows = [(i, prose(i, 40) if i % 2 else prose(i, 40).upper() + "!!") for i in range(200)]
    d = docs(*rows, (900, None), (901, ""), (None, "abc"), (902, "x" * 30000), (1, prose(1, 40)))
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(None, 1), (7, None), (3, 1), (900, 1), (900, 0)],
                                   "doc_id long, quality int")
    out = scored(d, train(d, labels)).collect()
    assert len(out) == 205 and all(0 <= r.score <= 1 for r in out)
    held = [r for r in out if r.held_out and r.doc_id is not None and r.doc_id < 200]
    assert len(held) > 20 and all(r.predicted == r.doc_id % 2 for r in held)
    got = {r.doc_id: r.score for r in out}
    assert got[900] == got[901]
    flat = scored(d, train(d, labels.limit(0))).select("score").distinct().collect()
    assert [r.score for r in flat] == [0.5]
    assert scored(d.limit(0), train(d.limit(0), labels)).count() == 0


# ---- 2 line runs ----

def model_runs(texts, size):
    seen, out = set(), {}
    for i, t in sorted(texts.items()):
        lines = t.split("\n") if t else []
        gone = set()
        for p in range(len(lines) - size + 1):
            w = tuple(lines[p:p + size])
            if w in seen:
                gone |= set(range(p, p + size))
            seen.add(w)
        out[i] = (len(lines), len(gone), "\n".join(x for k, x in enumerate(lines) if k not in gone))
    return out


@pytest.mark.parametrize("size", [1, 2, 3])
def test_line_runs_against_a_plain_model(docs, size):
    rng = random.Random(size)
    texts = {i: "\n".join(rng.choice("abcd") if rng.random() < 0.7 else f"u{i}{k}" for k in range(rng.randint(0, 14))) for i in range(14)}
    texts |= {50: texts[3], 51: "", 52: "\n".join("same" for _ in range(9)), 53: "z" * 50000}
    out = by_id(without_repeated_runs(docs(*texts.items()), min_lines=size))
    assert {i: (r.n_lines, r.n_removed, r.kept_text) for i, r in out.items()} == model_runs(texts, size)


def test_line_runs_edges(docs):
    d = docs((None, "p\nq"), (1, "p\nq"), (2, None), (2, None), (3, "p\nq\nr"), (3, "p\nq\nr"))
    out = sorted(((r.doc_id, r.n_lines, r.n_removed) for r in without_repeated_runs(d).collect()), key=str)
    assert out == [(1, 2, 2), (2, 0, 0), (2, 0, 0), (3, 3, 2), (3, 3, 2), (None, 2, 0)]
    assert without_repeated_runs(d.limit(0)).count() == 0


def test_registered_runs_of_one_line(spark, tmp_path, docs):
    texts = {1: "head\nbody one", 2: "whole text", 3: "head\nbody two\nhead", 4: "whole text", 5: "a\n\nb\n\nc"}
    docs(*texts.items()).write.parquet(f"{tmp_path}/documents.parquet")
    got = by_id(QUERIES["op2_line_runs_of_one"](spark, str(tmp_path)))
    assert {i: (r.n_lines, r.n_removed, r.n_runs) for i, r in got.items()} == {1: (2, 0, 0), 2: (1, 0, 0), 3: (3, 2, 2), 4: (1, 1, 1), 5: (5, 1, 1)}
    assert got[3].kept_md5 == hashlib.md5(b"body two").hexdigest() and got[4].kept_md5 == hashlib.md5(b"").hexdigest()


def test_ranks_sort_suffixes(docs):
    d = docs((1, "a\nb\na\nb\na\nu\nb\na"), (2, "b\na\nb\nv"))
    ranks = suffix_ranks(repeated_lines(_documents(d, "doc_id", "text"))).collect()
    lines = {(r.d.id, r.pos): r.line for r in ranks}

    def suffix(r):
        out, p = [], r.pos
        while (r.d.id, p) in lines:
            out.append(lines[r.d.id, p])
            p += 1
        return out

    order = sorted(ranks, key=lambda r: r["rank"])
    suffixes = [suffix(r) for r in order]
    assert suffixes == sorted(suffixes)


# ---- 3 rules ----

def test_rules_counts_and_edges(docs):
    good = [(i, prose(i, 50)) for i in range(30)]
    looped = " ".join(["one two three four five six"] * 3 + [prose(7, 20)])
    d = docs(*good, (100, None), (101, "few words"), (102, looped), (103, "## " * 30 + prose(5, 30)), (104, "l\n" * 3 + prose(6, 30)), (105, "w " * 40000))
    out = by_id(quality_rules(d))
    assert (out[100].n_words, out[100].base_failed, out[100].kept) == (0, True, False) and out[101].base_failed
    assert out[102].n_repeat_words == 18 and out[102].base_failed
    assert out[105].n_words == 40000 and out[105].n_repeat_words == 40000
    assert (out[103].n_symbols, out[103].base_failed, out[103].kept) == (60, True, False)
    assert out[104].n_dup_lines == 2 and all(out[i].kept for i, _ in good)
    assert out[0].word_chars == len(good[0][1].replace(" ", ""))
    assert passing(d).columns == d.columns and quality_rules(d.limit(0)).count() == 0


def test_rules_adapt_to_the_group(spark):
    rows = [(i, prose(i, 60), "en", "calm") for i in range(250)] + [(1000 + i, prose(i, 60).replace(" ", " # "), "en", "code") for i in range(250)]
    rows += [(5000, prose(1, 60).replace(" ", " # "), "en", "calm"), (5001, prose(2, 60), None, None), (5001, prose(2, 60), None, None)]
    out = quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    got = Counter((r.doc_id >= 5000 and r.doc_id, r.kept) for r in out.collect())
    assert got[False, True] == 500 and got[5000, False] == 1 and got[5001, True] == 2


# ---- 4 decontamination ----

def test_benchmark_windows(spark, docs):
    item = prose(1, 30).split()
    near = item[:14] + ["changed"] + item[15:]
    end = item[:28] + ["x", "y"]
    d = docs((1, prose(2, 50) + " " + " ".join(item).upper() + " " + prose(3, 20)), (2, " ".join(near)), (3, prose(4, 9) + " " + " ".join(end)),
             (4, None), (5, "one two"), (6, " ".join(item[:26])), (7, prose(9, 500)), (None, " ".join(item)), (5, "one two"))
    items = spark.createDataFrame([(10, " ".join(item)), (11, "two"), (12, None), (13, "")], "item_id long, text string")
    hits = sorted(((r.doc_id, r.item_id, r.first_word, r.n_words, round(r.similarity, 3)) for r in benchmark_hits(d, items).collect()), key=str)
    assert hits == sorted([(1, 10, 50, 30, 1.0), (3, 10, 7, 30, round(24 / 28, 3)), (6, 10, 0, 26, round(22 / 26, 3)), (None, 10, 0, 30, 1.0),
                           (5, 11, 1, 1, 1.0), (5, 11, 1, 1, 1.0)], key=str)
    blocks = benchmark_hits(d, items, block_bytes=1)
    assert sorted(map(str, blocks.collect())) == sorted(map(str, benchmark_hits(d, items).collect()))
    assert sorted((r.doc_id for r in without_benchmark(d, items).collect()), key=str) == [2, 4, 7, None]
    assert benchmark_hits(d, items.limit(0)).count() == 0 and benchmark_hits(d.limit(0), items).count() == 0


def test_rows_are_decontaminated_one_by_one(spark, docs):
    item = prose(1, 30)
    d = docs((None, item), (None, prose(2, 40)), (5, "x " + item), (5, prose(3, 40)), (6, prose(4, 40)))
    items = spark.createDataFrame([(10, item)], "item_id long, text string")
    for rows, left in ((d, {(None, prose(2, 40)), (5, prose(3, 40)), (6, prose(4, 40))}), (d.filter("doc_id = 6"), {(6, prose(4, 40))})):
        out = rows_without_benchmark(rows, items)
        assert {(r.doc_id, r.text) for r in out.collect()} == left and out.columns == d.columns


# ---- 5 archives ----

def test_archives_round_trip(spark):
    big, odd = "q" * 200, "WARC/1.1\r\n\r\n" + "é" * 100
    pages = spark.createDataFrame([(3, "http://a/ b", big, 1), (1, None, big, 1), (2, "u", None, 1), (4, "u", "short", 1), (5, "u", "short", 1),
                                   (6, "u", odd, 1), (None, "u", odd, 1), (7, "u", "z" * 3_000_000, 1)], "page_id long, url string, html string, name int")
    folder = scratch(spark)
    rank = "try_cast(regexp_extract(cast(http as string), 'X-Page-Id: ([^\\r]*)', 1) as long)"
    converted_archives(arc_archives(pages, most=1000), folder, rank)
    back = warc_records(read_archives(spark, folder)).selectExpr(f"{rank} as page_id", "*").collect()
    got = {r.page_id: r for r in back}
    assert len(back) == 8 and len({r.record_id for r in back}) == 8
    assert got[3].type == "revisit" and got[3].refers_to == got[1].record_id and got[3].payload_bytes == 200
    assert got[3].payload_digest == hashlib.sha256(big.encode()).hexdigest() == got[1].payload_digest
    assert got[1].url == "about:blank" and got[3].url == "http://a/%20b" and got[1].date == "1970-01-01T00:00:01Z"
    assert got[2].payload_bytes == 0 and got[4].type == got[5].type == "response"
    assert got[None].type == "response" and got[6].type == "revisit" and bytes(got[None].payload).decode() == odd
    assert len(got[7].payload) == 3_000_000
    assert converted(arc_archives(pages.limit(0))).count() == 0


def test_arc_versions_and_damage():
    for version in (1, 2):
        data = arc_block("a", "20200102030405", version) + arc_record("a", 0, "dns:x", "bad", "text/dns", b"1.2.3.4", version)
        data += arc_record("a", 0, "http://h", "20210102030405", "text/html; charset=x", b"HTTP/1.0 200 OK\r\n\r\nhi", version)
        one, two = parsed_arc("a", data)
        assert (one["type"], one["date"], one["payload"]) == ("resource", "2020-01-02T03:04:05Z", b"1.2.3.4")
        assert (two["type"], two["mime"], two["payload"], two["payload_bytes"]) == ("response", "text/html; charset=x", b"hi", 2)
        assert [r.get("error") is None for r in parsed_arc("a", data[:-1])] == [True, False]
    assert list(parsed_arc("e", b"")) == [] and "error" in next(parsed_arc("e", b"junk\n"))


# ---- 6 near-duplicates ----

def test_near_duplicates(docs):
    base = prose(1, 200).split()
    off = lambda *at: " ".join("new" + str(i) if i in at else w for i, w in enumerate(base))
    d = docs((5, off()), (9, off().upper()), (7, off(3)), (8, off(3, 190)), (4, prose(8, 100)), (3, ""), (2, None), (1, "a b"), (6, "A  b"),
             (None, off()), (None, off()), (12, off()), (12, off()), (13, " "), (14, "w " * 60000))
    out = near_duplicates(d, percent=85).collect()
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in out}
    assert {i: got[i][1] for i in (5, 7, 8, 9, 12, 4, 3, 2, 1, 6, 13)} == {5: 5, 7: 5, 8: 5, 9: 5, 12: 5, 4: 4, 3: 3, 2: 2, 1: 1, 6: 1, 13: 13}
    assert got[1] == (1, 1, True) and got[6] == (1, 1, False) and got[2][0] == got[3][0] == got[13][0] == 0 and got[14][0] == 1
    assert sum(r.doc_id is None and r.kept for r in out) == 2
    assert sorted(r.doc_id for r in one_of_each(d, percent=85).filter("doc_id is not null").collect()) == [1, 2, 3, 4, 5, 13, 14]
    assert near_duplicates(d.limit(0)).count() == 0


def test_rows_without_or_with_equal_ids_are_deduplicated(docs):
    base, other = prose(1, 60), prose(2, 60)
    d = docs((None, base), (None, base.upper()), (7, base), (3, other), (3, prose(3, 60)), (3, other), (None, ""), (None, prose(4, 60)), (None, prose(4, 60)))
    out = sorted(((r.doc_id, r.text) for r in one_of_each(d).collect()), key=str)
    assert out == sorted([(7, base), (3, other), (3, prose(3, 60)), (None, ""), (None, prose(4, 60))], key=str)
    assert one_of_each(d).columns == d.columns and one_of_each(d.limit(0)).count() == 0


# ---- 7 repeated bytes ----

def model_repeats(texts):
    seen, out = set(), {}
    for i, t in sorted(texts.items()):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            w = b[p:p + 100]
            if w in seen:
                gone[p:p + 100] = b"\1" * 100
            seen.add(w)
        spans = sum(1 for k in range(len(b)) if gone[k] and (not k or not gone[k - 1]))
        out[i] = (len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone) if not g))
    return out


@pytest.mark.parametrize("group_rows", [5000, 1])
def test_repeated_bytes_against_a_plain_model(docs, group_rows):
    rng = random.Random(4)
    parts = [prose(i, 40) for i in range(5)]
    texts = {}
    for i in range(40):
        t = "".join((p := rng.choice(parts))[rng.randint(0, 30):rng.randint(90, len(p))] + rng.choice("xyz") * rng.randint(0, 60) for _ in range(4))
        texts[i] = t
    texts |= {60: texts[1], 61: None, 62: "", 63: "a" * 300, 64: "ab" * 90, 65: "é" * 120, 66: "s" * 99, 67: prose(3, 20000)}
    out = by_id(without_repeats(docs(*texts.items()), group_rows=group_rows))
    assert {i: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for i, r in out.items()} == model_repeats(texts)


def test_repeated_bytes_edges(docs):
    t = prose(2, 60)
    out = without_repeats(docs((None, t), (3, t), (3, t), (1, "x"))).collect()
    assert sorted(r.n_removed for r in out) == [0, 0, len(t), len(t)] and [r.n_removed for r in out if r.doc_id is None] == [0]
    assert without_repeats(docs((1, "x")).limit(0)).count() == 0


def test_linear_grouping_sorts_suffixes():
    for seed in range(800):
        rng = random.Random(seed)
        t = [rng.randint(1, rng.choice([1, 2, 3, 9])) for _ in range(rng.randint(0, 40))] + [0]
        assert suffix_array(t) == sorted(range(len(t)), key=lambda i: t[i:])


# ---- 8 chat ----

@pytest.mark.parametrize("text", ["", "</s>[INST] ok [/INST]", "\\[\\INST]\\", "<<SYS>>x<</SYS>>", "[ROLE a] <s> \\\\", "é\n 漢字 😀"])
def test_escapes(text):
    assert unescaped(escaped(text)) == text
    turns = [("user", text), ("assistant", text), ("tool x]", text), ("", text), ("system", text)]
    assert parsed(rendered(turns)[0]) == turns


def test_chat_masks(spark):
    said = "</s>[INST] ok [/INST]"
    rows = [(1, 1, "assistant", "  two\n", 0), (1, 0, "user", said, 0), (1, 2, "assistant", said, 0), (2, 0, None, None, 0), (3, 0, "assistant", None, 0),
            (None, 0, "assistant", "é😀" * 3000, 0), (1, 2, "assistant", said, 0)]
    out = formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, conv int"))
    got = by_id(digests(out), "conv_id")
    want = "  two\n" + said + said
    assert (got[1].n_turns, got[1].loss_chars, got[1].loss_sha256) == (4, len(want), hashlib.sha256(want.encode()).hexdigest())
    assert got[2].loss_chars == got[3].loss_chars == 0 and got[None].loss_chars == 6000
    one = out.filter("conv_id = 1").first()
    assert len(one.token_ids) == len(one.loss_mask) and any(one.loss_mask) and not all(one.loss_mask)
    assert formatted(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


# ---- 9 sharding ----

def test_lookup_table():
    names = [f"n{i}" for i in range(7)]
    table = lookup_table(names, 1009)
    counts = Counter(table)
    assert max(counts.values()) - min(counts.values()) <= 1 and len(table) == 1009
    fewer = lookup_table(names[:-1], 1009)
    moved = sum(a != b for a, b in zip(table, fewer) if a != 6)
    assert moved < 0.2 * 1009
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            lookup_table(bad, 1009)
    with pytest.raises(ValueError):
        lookup_table(["a"], 1000)


def test_placement(spark, docs):
    d = docs(*[(i % 50, "t") for i in range(100)], (None, "t"))
    table = lookup_table(["a", "b", "c"], 101)
    out = placed(d, "doc_id", ["a", "b", "c"], 101)
    assert out.count() == 101 and out.columns == [*d.columns, "shard"]
    for r in out.collect():
        key = "" if r.doc_id is None else str(r.doc_id)
        assert r.shard == "abc"[table[int(hashlib.md5(key.encode()).hexdigest()[:15], 16) % 101]]
    with pytest.raises(ValueError):
        placed(d, "doc_id", ["a"], name="text")
    assert placed(d.limit(0), "doc_id", ["a"], 101).count() == 0


# ---- 10 mixing ----

def test_one_period_deviates_by_less_than_a_block():
    for seed in range(60):
        rng = random.Random(seed)
        period = rng.choice([24, 100, 1000])
        share = shares({f"s{i}": rng.choice([1, 2, 0.5, 7, 20]) for i in range(rng.randint(1, 12))}, period)
        count = dict.fromkeys(share, 0)
        for t, s in enumerate(one_period(share, period), 1):
            count[s] += 1
            assert all(abs(count[k] - Fraction(share[k] * t, period)) < 1 for k in share)
        assert count == share


def model_mix(rows, weights, block, period):
    """Slots by walking the schedule one block at a time."""
    queue = {}
    for s in {r[1] for r in rows}:
        own = sorted((hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:8], "" if i is None else str(i), i) for i, x in rows if x == s)
        queue[s] = [[i for *_, i in own[k:k + block]] for k in range(0, len(own), block)]
    out, slot, at = {}, 0, dict.fromkeys(queue, 0)
    while any(at[s] < len(q) for s, q in queue.items()):
        plan = one_period(shares({s: weights.get(s, 1) for s, q in queue.items() if at[s] < len(q)}, period), period)
        ended = False
        while not ended:
            for s in plan:
                for place, i in enumerate(queue[s][at[s]]):
                    out[i] = (s, at[s], slot, place)
                at[s] += 1
                slot += 1
                if at[s] == len(queue[s]):
                    ended = True
                    break
    return out


def test_mixing_against_a_walk(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["a", "a", "a", "b", "c", None])) for i in range(400)] + [(None, "c")]
    df = spark.createDataFrame(rows, "doc_id long, source string")
    out = mixed(df, {"a": 3, "b": 0.5}, block_rows=7, period=20, range_rows=50)
    got = {r.row.doc_id: (r.source, r.block, r.slot, r.place) for r in out.collect()}
    assert got == model_mix(rows, {"a": 3, "b": 0.5}, 7, 20)
    order = [r.doc_id for r in mixed_order(df, {"a": 3}, block_rows=7, period=20).collect()]
    assert Counter(order) == Counter(i for i, _ in rows)
    assert mixed(df.limit(0), {}).count() == 0 and phases({}, {}, 10) == []
    with pytest.raises(ValueError):
        mixed(df, {"a": -1})


@pytest.mark.parametrize("weights", [{"src0": 4, "src1": 3, "src2": 2, **{f"src{i}": 1 for i in range(3, 20)}}, {"a": 0.1, "b": 0.7, "c": 2.5},
                                     {"a": 5, "b": Fraction(1, 3)}, {f"s{i}": 1 + i % 3 for i in range(1200)}])
def test_mix_follows_the_target_weights_over_many_periods(weights):
    total = sum(Fraction(str(w)) for w in weights.values())
    blocks = {s: 40 + int(3000 * Fraction(str(w)) / total) for s, w in weights.items()}
    (_, first, plan), *_ = steps = phases(blocks, weights)
    until = steps[1][0] if len(steps) > 1 else sum(blocks.values())
    assert until > 3000 and set(first.values()) == {0}
    count, near = dict.fromkeys(weights, 0), 0
    for t in range(until):
        count[plan[t % len(plan)]] += 1
        if t % 41 == 0 or t < 60:
            near = max(near, *(abs(count[s] - Fraction(str(w)) / total * (t + 1)) for s, w in weights.items()))
    assert near < 1


def test_mixing_takes_more_sources_than_a_thousand_and_long_periods(spark):
    df = spark.createDataFrame([(i, f"s{i % 1100}") for i in range(2200)], "doc_id long, source string")
    out = mixed(df, {"s0": 3, "s1": 0.123456789}, block_rows=1)
    assert sorted(r.slot for r in out.collect()) == list(range(2200))
    assert whole_weights({"a": 0.5, "b": 1, "c": Fraction(3, 2)}) == {"a": 1, "b": 2, "c": 3}
