"""Concept routing, roaming, retrieval, citations and recall over texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtable.functions.texts import word_list
from loomtable.operators.concepts import navigate, roam_concepts, route_questions
from loomtable.operators.recall import add_memories, recall_index, recall_situations, recall_statistics
from loomtable.operators.retrieval import retrieve_nodes
from loomtable.operators.windows import number_rows
from loomtable.plans.suite.base import Tables, query
from loomtable.session import cut_lineage

# Concepts: one per source of the documents; its aliases are pairs of words.
_CONCEPTS_SQL = r"""
    WITH RECURSIVE src AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS i, count(*) OVER () AS n
                           FROM (SELECT DISTINCT source FROM documents)),
    tok AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w
            FROM benchmark),
    bi AS (SELECT item_id, s AS start, w[s] || ' ' || w[s + 1] AS gram
           FROM tok, unnest(range(1, len(w))) u(s)),
    rare AS (SELECT gram, row_number() OVER (ORDER BY gram) AS g FROM (SELECT DISTINCT gram FROM bi)),
    one AS (SELECT word, row_number() OVER (ORDER BY word) AS g FROM (SELECT DISTINCT unnest(w) AS word FROM tok)),
    al AS (SELECT gram AS alias_key, source AS concept_id FROM rare JOIN src ON i = g % n
           UNION ALL SELECT word, source FROM one JOIN src ON i = g % n),
    rel AS (SELECT a.source AS from_concept_id, b.source AS to_concept_id, 'supports' AS relation_type, a.i AS position
            FROM src a JOIN src b ON b.i = (a.i + 1) % a.n
            UNION ALL SELECT a.source, b.source, 'depends_on', a.i FROM src a JOIN src b ON b.i = (a.i * 3 + 2) % a.n)"""


def _questions(t):
    return t.benchmark.select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))


def _ontology(spark, sf):
    t = Tables(spark, sf)
    sources = t.documents.select("source").distinct()
    n = sources.count()
    src = number_rows(sources, [], ["source"], "i").withColumn("i", F.col("i") - 1)
    w = cut_lineage(t.benchmark.select("item_id", word_list(F.lower("text")).alias("w")))
    grams = w.select(F.explode(F.when(F.size("w") > 1, F.transform(
        F.sequence(F.lit(1), F.size("w") - 1), lambda s: F.array_join(F.slice("w", s, 2), " ")))).alias("alias")).distinct()
    words = w.select(F.explode("w").alias("alias")).distinct()
    number = lambda df: number_rows(df, [], ["alias"], "g")
    picked = number(grams).unionByName(number(words))
    aliases = picked.join(src, F.col("i") == F.col("g") % n).select(F.col("source").alias("concept_id"), "alias")
    to = src.select(F.col("source").alias("to_concept_id"), F.col("i").alias("j"))
    edge = lambda target, kind: src.join(to, F.col("j") == target % n).select(
        F.col("source").alias("from_concept_id"), "to_concept_id", F.lit(kind).alias("relation_type"),
        F.col("i").cast("bigint").alias("position"))
    relations = edge(F.col("i") + 1, "supports").unionByName(edge(F.col("i") * 3 + 2, "depends_on"))
    nodes = t.documents.select(
        F.col("doc_id").alias("node_id"), F.concat(F.lit("about "), F.col("lang")).alias("title"),
        F.col("text").alias("body"), F.array("source").alias("concept_ids"),
        F.array(F.struct(F.col("source").alias("source_ref"), (F.col("doc_id") % 10).cast("string").alias("locator")),
                F.struct(F.col("lang").alias("source_ref"), F.lit("all").alias("locator"))).alias("evidence_refs"))
    return _questions(t), cut_lineage(aliases), cut_lineage(relations), nodes


# Longest spans first: pairs, then single words, each left to right without overlap.
_ROUTES_SQL = _CONCEPTS_SQL + """,
    pairs AS (SELECT item_id, start, concept_id FROM bi JOIN al ON alias_key = gram),
    seq AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY start) AS k FROM pairs),
    walk AS (SELECT item_id, k, start AS last, concept_id, true AS ok FROM seq WHERE k = 1
             UNION ALL SELECT s.item_id, s.k, CASE WHEN s.start > last + 1 THEN s.start ELSE last END, s.concept_id,
                              s.start > last + 1 FROM walk JOIN seq s ON s.item_id = walk.item_id AND s.k = walk.k + 1),
    took AS (SELECT item_id, last AS start, 2 AS length, concept_id FROM walk WHERE ok),
    ones AS (SELECT item_id, s AS start, concept_id FROM tok, unnest(range(1, len(w) + 1)) u(s) JOIN al ON alias_key = w[s]
             WHERE NOT EXISTS (SELECT 1 FROM took WHERE took.item_id = tok.item_id AND s IN (took.start, took.start + 1))),
    met AS (SELECT * FROM took UNION ALL SELECT item_id, start, 1, concept_id FROM ones),
    firsts AS (SELECT item_id, concept_id, min((-length, start)) AS o FROM met GROUP BY ALL),
    routes AS (SELECT item_id AS question_id, concept_id, row_number() OVER (PARTITION BY item_id ORDER BY o) AS place
               FROM firsts)"""


@query("routed_questions", _ROUTES_SQL + """
    SELECT question_id, string_agg(concept_id, ',' ORDER BY place) AS concepts FROM routes GROUP BY 1""")
def routed(spark, sf):
    questions, aliases, _, _ = _ontology(spark, sf)
    return route_questions(questions, aliases).select("question_id", F.array_join("concept_ids", ",").alias("concepts"))


_SCOPE_SQL = _ROUTES_SQL + """,
    s0 AS (SELECT question_id, concept_id, place FROM routes WHERE place <= 100),
    c1 AS (SELECT s.question_id, r.to_concept_id AS concept_id, r.from_concept_id, r.relation_type,
                  (s.place, CASE r.relation_type WHEN 'depends_on' THEN 1 ELSE 2 END, r.position) AS o
           FROM s0 s JOIN rel r ON r.from_concept_id = s.concept_id
           WHERE NOT EXISTS (SELECT 1 FROM s0 x WHERE x.question_id = s.question_id AND x.concept_id = r.to_concept_id)),
    d1 AS (SELECT *, row_number() OVER (PARTITION BY question_id, concept_id ORDER BY o) AS dup FROM c1),
    s1 AS (SELECT question_id, concept_id, from_concept_id, relation_type,
                  row_number() OVER (PARTITION BY question_id ORDER BY o)
                  + (SELECT count(*) FROM s0 x WHERE x.question_id = d1.question_id) AS place FROM d1 WHERE dup = 1),
    t1 AS (SELECT * FROM s1 WHERE place <= 100),
    v1 AS (SELECT question_id, concept_id FROM s0 UNION ALL SELECT question_id, concept_id FROM t1),
    c2 AS (SELECT s.question_id, r.to_concept_id AS concept_id, r.from_concept_id, r.relation_type,
                  (s.place, CASE r.relation_type WHEN 'depends_on' THEN 1 ELSE 2 END, r.position) AS o
           FROM t1 s JOIN rel r ON r.from_concept_id = s.concept_id
           WHERE NOT EXISTS (SELECT 1 FROM v1 x WHERE x.question_id = s.question_id AND x.concept_id = r.to_concept_id)),
    d2 AS (SELECT *, row_number() OVER (PARTITION BY question_id, concept_id ORDER BY o) AS dup FROM c2),
    s2 AS (SELECT question_id, concept_id, from_concept_id, relation_type,
                  row_number() OVER (PARTITION BY question_id ORDER BY o)
                  + (SELECT count(*) FROM v1 x WHERE x.question_id = d2.question_id) AS place FROM d2 WHERE dup = 1),
    scope AS (SELECT question_id, concept_id, place, 0 AS depth, NULL AS from_concept_id, NULL AS relation_type FROM s0
              UNION ALL SELECT question_id, concept_id, place, 1, from_concept_id, relation_type FROM t1
              UNION ALL SELECT question_id, concept_id, place, 2, from_concept_id, relation_type FROM s2 WHERE place <= 100)"""


def _scope(spark, sf, most=100):
    questions, aliases, relations, nodes = _ontology(spark, sf)
    routes = route_questions(questions, aliases)
    return questions, nodes, roam_concepts(routes, relations, ["depends_on", "supports"], 2, most)


@query("roamed_concepts", _SCOPE_SQL + """
    SELECT question_id, concept_id, place, depth, from_concept_id, relation_type FROM scope""")
def roamed(spark, sf):
    return _scope(spark, sf)[2]


@query("roamed_concepts_bounded", _SCOPE_SQL.replace("place <= 100", "place <= 4") + """
    SELECT question_id, concept_id, place, depth, from_concept_id, relation_type FROM scope""")
def roamed_bounded(spark, sf):
    """The walk stops at the bound that the caller sets."""
    return _scope(spark, sf, 4)[2]


@query("retrieved_nodes", _SCOPE_SQL + r""",
    q AS (SELECT item_id AS question_id, list_distinct(regexp_split_to_array(
             translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\p{L}\p{N}]+')) AS qw FROM benchmark),
    nw AS (SELECT doc_id AS node_id, source, list_distinct(regexp_split_to_array(translate('about ' || lang || ' ' || text,
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\p{L}\p{N}]+')) AS nw FROM documents)
    SELECT * FROM (SELECT s.question_id, node_id, len(list_filter(list_intersect(qw, nw), lambda w: w <> '')) AS score
                   FROM scope s JOIN nw ON nw.source = s.concept_id JOIN q ON q.question_id = s.question_id) WHERE score > 0
    QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY score DESC, node_id) <= 25""")
def retrieved(spark, sf):
    questions, nodes, scope = _scope(spark, sf)
    return retrieve_nodes(questions, scope, nodes, top_k=25)


@query("navigated_citations", _ROUTES_SQL + r""",
    z0 AS (SELECT question_id, concept_id, place FROM routes WHERE place <= 4),
    z1 AS (SELECT s.question_id, r.to_concept_id AS concept_id,
                  min((s.place, CASE r.relation_type WHEN 'supports' THEN 1 ELSE 2 END, r.position)) AS o
           FROM z0 s JOIN rel r ON r.from_concept_id = s.concept_id
           WHERE NOT EXISTS (SELECT 1 FROM z0 x WHERE x.question_id = s.question_id AND x.concept_id = r.to_concept_id)
           GROUP BY ALL),
    z2 AS (SELECT question_id, concept_id, row_number() OVER (PARTITION BY question_id ORDER BY o)
                  + (SELECT count(*) FROM z0 x WHERE x.question_id = z1.question_id) AS place FROM z1),
    zs AS (SELECT question_id, concept_id FROM z0 UNION ALL SELECT question_id, concept_id FROM z2 WHERE place <= 4),
    q AS (SELECT item_id AS question_id, list_filter(list_distinct(regexp_split_to_array(
             translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\p{L}\p{N}]+')), lambda w: w <> '') AS qw
          FROM benchmark),
    nw AS (SELECT doc_id AS node_id, source, lang, list_distinct(regexp_split_to_array(translate('about ' || lang || ' ' || text,
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\p{L}\p{N}]+')) AS nw FROM documents),
    hits AS (SELECT zs.question_id, node_id, source, lang, len(list_intersect(qw, nw)) AS score
             FROM zs JOIN nw ON nw.source = zs.concept_id JOIN q ON q.question_id = zs.question_id),
    refs AS (SELECT question_id, node_id, score, 0 AS pos, source AS source_ref, (node_id % 10)::VARCHAR AS locator FROM hits
             WHERE score > 0 UNION ALL SELECT question_id, node_id, score, 1, lang, 'all' FROM hits WHERE score > 0),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY question_id, source_ref, locator ORDER BY score DESC, node_id, pos) AS dup
               FROM refs)
    SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, node_id, pos) AS citation, source_ref,
           locator, node_id FROM ranked WHERE dup = 1""")
def citations(spark, sf):
    return navigate(*_ontology(spark, sf), ["supports", "depends_on"], 1, 4)["citations"]


_RECALL_SQL = r"""
    WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents),
    st AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM d),
    tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM d) GROUP BY ALL),
    f AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM tf, st GROUP BY term, n),
    x AS (SELECT term, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM f) ELSE idf END AS idf FROM f),
    q AS (SELECT item_id, term, count(*) AS qf FROM (
            SELECT item_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS term FROM benchmark) GROUP BY ALL),
    s AS (SELECT item_id, doc_id, sum(idf * qf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score
          FROM q JOIN x USING (term) JOIN tf USING (term), st GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank,
                 max(score) OVER (PARTITION BY item_id) AS top FROM s)
    SELECT item_id AS situation_id, doc_id AS memory_id, rank, round(score, 4) AS score, round(score / top, 6) AS similarity_score
    FROM r WHERE rank <= 3"""


@query("recalled_situations", _RECALL_SQL)
def recalled(spark, sf):
    t = Tables(spark, sf)
    return _recalled(recall_situations(t.documents.select(F.col("doc_id").alias("memory_id"), "text"), _situations(t), 3))


@query("recalled_situations_of_batches", _RECALL_SQL)
def recalled_of_batches(spark, sf):
    """The same from an index that grew language by language, each batch counted once."""
    t = Tables(spark, sf)
    memories = t.documents.select(F.col("doc_id").alias("memory_id"), "text", F.coalesce("lang", F.lit("")).alias("lang"))
    languages = sorted(r[0] for r in memories.select("lang").distinct().collect())
    index = recall_index(memories.filter(F.col("lang") == languages[0]))
    statistics = recall_statistics(index)
    for lang in languages[1:]:
        index, statistics = add_memories(index, statistics, memories.filter(F.col("lang") == lang))
    return _recalled(recall_situations(None, _situations(t), 3, index, statistics))


def _situations(t):
    return t.benchmark.select(F.col("item_id").alias("situation_id"), "text")


def _recalled(out):
    return out.withColumns({"score": F.round("score", 4), "similarity_score": F.round("similarity_score", 6)})
