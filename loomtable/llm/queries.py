"""Registered queries: each applies one operator to its whole table; SQL states the same rows where it can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomtable.llm.archives import arc_archives, converted_archives, read_archives, warc_records
from loomtable.llm.chat import digests, formatted
from loomtable.llm.decontaminate import benchmark_hits
from loomtable.llm.line_runs import without_repeated_runs
from loomtable.llm.minhash import near_duplicates
from loomtable.llm.mixing import mixed
from loomtable.llm.pieces import decoded, encoded
from loomtable.llm.quality import scored, train
from loomtable.llm.ranked_scan import best_documents
from loomtable.llm.repeats import without_repeats
from loomtable.llm.rules import MEASURES, quality_rules
from loomtable.llm.sharding import lookup_table, placed
from loomtable.llm.survival import filter_audit
from loomtable.llm.tables import scratch, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
FOLDED_WORDS = WORDS.format(f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')")


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def near_duplicate_sql(source: str, percent: int) -> str:
    """CTEs ending in near(doc_id, n_shingles, component_id)."""
    return f"""
w as (select doc_id, {FOLDED_WORDS} as words from {source}),
s as (select distinct doc_id, unnest(case when len(words) = 0 then [] when len(words) < 5 then [array_to_string(words, ' ')]
        else [array_to_string(words[i:i + 4], ' ') for i in range(1, len(words) - 3)] end) as shingle from w),
n as (select doc_id, count(*) as n from s group by doc_id),
common as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.shingle = b.shingle and a.doc_id <> b.doc_id
        group by 1, 2),
links as (select a, b from common join n x on x.doc_id = a join n y on y.doc_id = b
        where 100 * c >= {percent} * (x.n + y.n - c)),
reach as (select doc_id as id, doc_id as other from {source} union select id, b from reach join links on a = other),
near as (select d.doc_id, coalesce(any_value(n.n), 0) as n_shingles, min(other) as component_id
        from {source} d left join n on n.doc_id = d.doc_id join reach on id = d.doc_id group by d.doc_id)"""


@query("op6_near_duplicates", f"""with recursive {near_duplicate_sql('documents', 85)}
select *, doc_id = component_id as kept from near""")
def op6(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def quality_rules_sql(source: str) -> str:
    """CTEs ending in judged(doc_id, counts, base_failed, kept)."""
    space = r"[^\x20\x09-\x0D]"
    rates = {m: f"coalesce({top} * 1000 // nullif({bottom}, 0), 0)" for m, (top, bottom, _, _) in MEASURES.items()}
    long = " union all ".join(f"select lang, source, '{m}' as measure, {r} as v from q_rows where not base_failed" for m, r in rates.items())

    def level(name, by):
        keys = "".join(f"{c}, " for c in by)
        return f"""
q_s_{name} as (select {keys}measure, low, sum(n) as n from q_sketch group by {keys}measure, low),
q_p_{name} as (select *, sum(n) over (partition by {keys}measure) as total,
        sum(n) over (partition by {keys}measure order by low rows unbounded preceding) as upto from q_s_{name}),
q_{name} as (select {keys}measure, max(total) as total, min(case when upto * 4 >= total then low end) as q1,
        min(case when upto * 4 >= 3 * total then low end) as q3 from q_p_{name} group by {keys}measure)"""

    tests = " and ".join(f"{rates[m]} <= hi_{m}" + (f" and {rates[m]} >= lo_{m}" if low else "") for m, (_, _, _, low) in MEASURES.items())
    return f"""
q_words as (select doc_id, lang, source, coalesce(text, '') as t, {WORDS.format("coalesce(text, '')")} as words,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '{space}')) as lines from {source}),
q_grams as (select doc_id, words[i:i + 4] as gram, i from (select doc_id, words, unnest(range(1, len(words) - 3)) as i from q_words)),
q_dups as (select doc_id, unnest(range(i, i + 5)) as p from (select *, count(*) over (partition by doc_id, gram) as c from q_grams) where c > 1),
q_rep as (select doc_id, count(distinct p) as r from q_dups group by doc_id),
q_counts as (select doc_id, lang, source, len(words) as n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) as word_chars,
        length(t) - length(regexp_replace(t, '[#*$%&|<>]+', '', 'g')) as n_symbols, len(lines) - len(list_distinct(lines)) as n_dup_lines,
        coalesce(r, 0) as n_repeat_words, len(lines) as n_lines, length(regexp_replace(t, '[^\\p{{Lu}}]+', '', 'g')) as n_upper,
        len(list_filter(range(2, len(words) + 1), lambda i: words[i] = words[i - 1])) as n_echoes
        from q_words left join q_rep using (doc_id)),
q_rows as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from q_counts),
q_sketch as (select lang, source, measure, (v >> greatest(length(bin(v)) - 7, 0)) << greatest(length(bin(v)) - 7, 0) as low, count(*) as n
        from ({long}) group by all),{level('fine', ['lang', 'source'])},{level('lang', ['lang'])},{level('all', [])},
q_used as (select f.lang, f.source, f.measure, case when f.total >= 200 then f.q1 when l.total >= 200 then l.q1 else a.q1 end as q1,
        case when f.total >= 200 then f.q3 when l.total >= 200 then l.q3 else a.q3 end as q3
        from q_fine f join q_lang l on f.lang is not distinct from l.lang and f.measure = l.measure join q_all a on a.measure = f.measure),
q_fence as (select lang, source, {', '.join(f"max(case when measure = '{m}' then q1 - greatest(3 * (q3 - q1), {s}) end) as lo_{m}, max(case when measure = '{m}' then q3 + greatest(3 * (q3 - q1), {s}) end) as hi_{m}" for m, (_, _, s, _) in MEASURES.items())}
        from q_used group by lang, source),
judged as (select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper, n_echoes, base_failed,
        not base_failed and coalesce({tests}, true) as kept
        from q_rows r left join q_fence f on r.lang is not distinct from f.lang and r.source is not distinct from f.source)"""


@query("op3_quality_rules", f"with {quality_rules_sql('documents')} select * from judged")
def op3(spark, sf_dir):
    return quality_rules(table(spark, sf_dir, "documents"))


def benchmark_hits_sql(source: str) -> str:
    """CTEs ending in hits(doc_id, item_id, first_word, n_words, similarity), by comparing every window that shares a shingle."""
    return f"""
b_docs as (select doc_id, {FOLDED_WORDS} as words from {source}),
b_items as (select item_id, {FOLDED_WORDS} as words from benchmark),
b_ds as (select doc_id, len(words) as n, i - 1 as p, array_to_string(words[i:i + 4], ' ') as g
        from (select doc_id, words, unnest(range(1, len(words) - 3)) as i from b_docs)),
b_is as (select item_id, len(words) as n, array_to_string(words[i:i + 4], ' ') as g
        from (select item_id, words, unnest(range(1, len(words) - 3)) as i from b_items)),
b_starts as (select distinct doc_id, item_id, d_n, n, unnest(range(greatest(0, p + 5 - n), least(p, greatest(0, d_n - n)) + 1)) as s
        from (select doc_id, b_ds.n as d_n, p, item_id, b_is.n as n from b_ds join b_is using (g))),
b_win as (select x.doc_id, x.item_id, x.s, x.n, x.d_n, d.g, count(*) as c from b_starts x
        join b_ds d on d.doc_id = x.doc_id and d.p between x.s and x.s + least(x.n, x.d_n) - 5 group by all),
b_ic as (select item_id, g, count(*) as c from b_is group by all),
b_sim as (select doc_id, item_id, s, w.n, d_n, sum(least(w.c, coalesce(i.c, 0))) as low, any_value(least(w.n, d_n)) - 4 + any_value(w.n) - 4 as total
        from b_win w left join b_ic i using (item_id, g) group by doc_id, item_id, s, w.n, d_n),
b_best as (select *, low / (total - low) as similarity,
        row_number() over (partition by doc_id, item_id order by low / (total - low) desc, s) as r from b_sim),
hits as (select doc_id, item_id, s as first_word, least(n, d_n) as n_words, similarity from b_best where r = 1 and similarity >= 0.8)"""


@query("op4_benchmark_hits", f"with {benchmark_hits_sql('documents')} select * from hits")
def op4(spark, sf_dir):
    return benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op1_quality_scores")
def op1(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return scored(docs, train(docs, table(spark, sf_dir, "labels")))


@query("op5_warc_records", """
with p as (select page_id, strlen(coalesce(html, '')) as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
f as (select *, min(page_id) over (partition by payload_digest) as first from p)
select page_id, payload_bytes, payload_digest, case when payload_bytes >= 100 and first < page_id then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= 100 and first < page_id then first end as refers_to from f""")
def op5(spark, sf_dir):
    folder = scratch(spark)
    page = "try_cast(regexp_extract(cast(http as string), 'X-Page-Id: ([^\\r]*)', 1) as long)"
    converted_archives(arc_archives(table(spark, sf_dir, "pages")), folder, page)
    back = written(warc_records(read_archives(spark, folder), payloads=False).select(
        F.expr(page).alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "record_id", "refers_to"))
    named = back.filter("record_type = 'response'").select(F.col("record_id").alias("refers_to"), F.col("page_id").alias("first"))
    return back.join(named, "refers_to", "left").select("page_id", "payload_bytes", "payload_digest", "record_type", F.col("first").alias("refers_to"))


@query("op8_chat_formatting", r"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e as (select *, length(regexp_replace(replace(text, '\', '\\'), '\[/?INST\]|</?s>|<</?SYS>>|\[/?ROLE[ \]]', '\0+', 'g'))
        + case role when 'user' then 15 when 'assistant' then 11 when 'system' then 18 else null end as chars from c)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
       cast(sum(chars) as bigint) as formatted_chars from e group by conv_id""")
def op8(spark, sf_dir):
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    talks = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return digests(formatted(talks))


SHARDS = [f"shard-{i:02d}" for i in range(16)]
SLOT_SQL = "(('0x' || substr(md5(coalesce(cast({} as varchar), '')), 1, 15))::bigint % 65537)"


def shard_sql(key: str) -> str:
    """The owner of a key's slot, read from the table written as one hexadecimal digit per slot."""
    digits = "".join(f"{o:x}" for o in lookup_table(SHARDS))
    return f"'shard-' || lpad(cast(('0x' || substr('{digits}', {SLOT_SQL.format(key)} + 1, 1))::bigint as varchar), 2, '0')"


@query("op9_shards", f"select doc_id, {shard_sql('doc_id')} as shard from documents")
def op9(spark, sf_dir):
    return placed(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", SHARDS)


#: target weights; a source that is not named has weight 1
WEIGHTS = {"src0": 4, "src1": 3, "src2": 2}


@query("op10_mixed_sources")
def op10(spark, sf_dir):
    out = mixed(table(spark, sf_dir, "documents"), WEIGHTS, carry=["doc_id"])
    return out.select("row.doc_id", "source", "block", "slot", "place")


@query("op2_line_runs", """
with l as (select doc_id, unnest(case when coalesce(text, '') = '' then [] else string_split(text, chr(10)) end) as line,
        generate_subscripts(case when coalesce(text, '') = '' then [] else string_split(text, chr(10)) end, 1) - 1 as pos from documents),
w as (select *, lead(line) over (partition by doc_id order by pos) as line2 from l),
n as (select *, row_number() over (partition by line, line2 order by doc_id, pos) as r from w where line2 is not null),
gone as (select distinct doc_id, unnest([pos, pos + 1]) as pos from n where r > 1),
m as (select l.*, g.pos is not null as g, lag(g.pos is not null, 1, false) over (partition by l.doc_id order by l.pos) as before
      from l left join gone g on g.doc_id = l.doc_id and g.pos = l.pos)
select d.doc_id, count(m.pos) as n_lines, count(*) filter (g) as n_removed, count(*) filter (g and not before) as n_runs,
       md5(coalesce(string_agg(line, chr(10) order by m.pos) filter (not g), '')) as kept_md5
from documents d left join m on m.doc_id = d.doc_id group by d.doc_id""")
def op2(spark, sf_dir):
    out = without_repeated_runs(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", "n_runs", F.md5("kept_text").alias("kept_md5"))


@query("op2_line_runs_of_one", """
with l as (select doc_id, unnest(case when coalesce(text, '') = '' then [] else string_split(text, chr(10)) end) as line,
        generate_subscripts(case when coalesce(text, '') = '' then [] else string_split(text, chr(10)) end, 1) - 1 as pos from documents),
n as (select *, row_number() over (partition by line order by doc_id, pos) > 1 as g from l),
m as (select *, lag(g, 1, false) over (partition by doc_id order by pos) as before from n)
select d.doc_id, count(m.pos) as n_lines, count(*) filter (g) as n_removed, count(*) filter (g and not before) as n_runs,
       md5(coalesce(string_agg(line, chr(10) order by m.pos) filter (not g), '')) as kept_md5
from documents d left join m on m.doc_id = d.doc_id group by d.doc_id""")
def op2_of_one(spark, sf_dir):
    """Repeated runs of any length: a single line that occurs earlier goes too."""
    out = without_repeated_runs(table(spark, sf_dir, "documents"), min_lines=1)
    return out.select("doc_id", "n_lines", "n_removed", "n_runs", F.md5("kept_text").alias("kept_md5"))


@query("op7_repeated_bytes", """
with b as (select doc_id, encode(coalesce(text, '')) as b from documents),
w as (select doc_id, p, array_slice(b, p, p + 99) as s from (select doc_id, b, unnest(range(1, octet_length(b) - 98)) as p from b)),
later as (select doc_id, p from (select doc_id, p, row_number() over (partition by s order by doc_id, p) as r from w) where r > 1),
mark as (select *, case when p - lag(p) over (partition by doc_id order by p) <= 100 then 0 else 1 end as fresh from later),
part as (select *, sum(fresh) over (partition by doc_id order by p) as k from mark),
gone as (select doc_id, k, min(p) as s, max(p) + 100 as e from part group by doc_id, k),
gaps as (select doc_id, k, s, e, coalesce(lag(e) over (partition by doc_id order by k), 1) as f from gone),
held as (select doc_id, string_agg(hex(array_slice(b, f, s - 1)), '' order by k) as h, max(e) as e, sum(g.e - s) as n, count(*) as c
        from gaps g join b using (doc_id) group by doc_id)
select doc_id, octet_length(b) as n_bytes, coalesce(n, 0)::bigint as n_removed, coalesce(c, 0) as n_spans,
       sha256(case when c is null then b else unhex(h || coalesce(hex(array_slice(b, held.e, octet_length(b))), '')) end) as kept_sha256
from b left join held using (doc_id)""")
def op7(spark, sf_dir):
    out = without_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


@query("op11_ranked_documents", f"""
with d as (select doc_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}') as w from documents),
c as (select count(*) filter (len(w) > 0) as n_all, sum(len(w))::bigint as l_all from d),
q as (select item_id, term, count(*) as times from (select item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) as term
        from benchmark) group by all),
t as (select doc_id, n, term, count(*) as tf from (select doc_id, len(w) as n, unnest(w) as term from d) where term in (select term from q) group by all),
w as (select term, floor(1000 * ln((2 * n_all + 2) / (2 * count(*) + 1)))::bigint as w from t, c group by term, n_all),
s as (select item_id, doc_id, sum(times * w * (1000000000 * tf // (1000 * tf + 12 * (75 + 25 * n * n_all // l_all))))::bigint as score
        from q join w using (term) join t using (term), c group by all),
r as (select *, row_number() over (partition by item_id order by score desc, doc_id)::integer as rank from s where score > 0)
select item_id, rank, doc_id, score from r where rank <= 20""")
def op11(spark, sf_dir):
    return best_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), top=20)


@query("op12_piece_ids")
def op12(spark, sf_dir):
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    back = decoded(encoded(table(spark, sf_dir, "documents"), model), model, ["doc_id", "n_tokens"])
    return back.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op13_filter_audit", f"""
with d as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as t, {WORDS.format("coalesce(text, '')")} as w from documents),
said as (select doc_id, max(quality = 1) as good, max(toxic = 1) as toxic from labels group by doc_id),
f as (select part, coalesce(good, false) as good, coalesce(toxic, false) as toxic,
        (len(w) < 50)::int + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::int + 4 * (100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 5 * length(t))::int
        + 8 * regexp_matches(t, '[#$%&*|]')::int + 16 * coalesce(doc_id > min(doc_id) over (partition by t), false)::int as failed
        from d left join said using (doc_id)),
g as (select part, failed, count(*) as n, count(*) filter (good) as n_good, count(*) filter (toxic) as n_toxic from f group by part, failed),
l as (select unnest(range(5)) as x),
o as (select [a.x, b.x, c.x, d.x, e.x] as p from l a join l b on b.x <> a.x join l c on c.x not in (a.x, b.x) join l d on d.x not in (a.x, b.x, c.x)
        join l e on e.x not in (a.x, b.x, c.x, d.x)),
s as (select array_to_string(list_transform(p, lambda x: substr('ABCDE', x + 1, 1)), '') as filter_order, step, p[step] as x, 1 << p[step] as bit,
        coalesce(list_sum(list_transform(p[1:step - 1], lambda x: 1 << x)), 0)::int as before
        from (select p, unnest(range(1, 6)) as step from o)),
r as (select part, filter_order, step, x,
        coalesce(sum(n) filter (failed & (before | bit) = 0), 0)::bigint as kept,
        coalesce(sum(n) filter (failed & before = 0 and failed & bit <> 0), 0)::bigint as removed,
        coalesce(sum(n) filter (failed & before <> 0 and failed & bit <> 0), 0)::bigint as redundant,
        coalesce(sum(n) filter (failed = bit), 0)::bigint as unique_fails,
        coalesce(sum(n_good) filter (failed & before = 0 and failed & bit <> 0), 0)::bigint as good_lost,
        coalesce(sum(n_toxic) filter (failed & before = 0 and failed & bit <> 0), 0)::bigint as toxic_lost
        from g, s group by part, filter_order, step, x)
select part, filter_order, step::integer as step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       sum(removed) over (partition by part, x)::bigint as shapley from r""")
def op13(spark, sf_dir):
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
