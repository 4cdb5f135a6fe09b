"""Concept routing, roaming over relations, and scoped retrieval, for many
questions at once.

Tables: aliases (concept_id, alias; the concept name is one of them),
relations (from_concept_id, to_concept_id, relation_type, position),
nodes (node_id, title, body, concept_ids, evidence_refs), questions
(question_id, question).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from loomtable.functions.checks import need_columns, need_some
from loomtable.functions.texts import word_list
from loomtable.functions.values import strip
from loomtable.operators.ordering import keep_one_per_key
from loomtable.operators.retrieval import retrieve_nodes
from loomtable.operators.windows import number_rows
from loomtable.registry import operator
from loomtable.session import cut_lineage

# Relation types between concepts.
RELATION_TYPES = ("parent_of", "child_of", "depends_on", "supports", "references", "adjacent_to")


@operator("check_aliases")
def check_aliases(aliases: DataFrame) -> DataFrame:
    """Normalised alias keys; a key of two concepts fails the job."""
    need_columns(aliases, ["concept_id", "alias"])
    keys = aliases.select(F.lower(strip(F.col("alias"))).alias("alias_key"), "concept_id").filter("alias_key <> ''")
    one = keys.groupBy("alias_key").agg(F.count(F.lit(1)).alias("n"), F.min("concept_id").alias("concept_id"))
    clash = F.raise_error(F.concat(F.lit("alias is given twice: "), F.col("alias_key"))).cast("string")
    return one.select("alias_key", F.when(F.col("n") > 1, clash).otherwise(F.col("concept_id")).alias("concept_id"))


@operator("alias_trie")
def alias_trie(aliases: DataFrame) -> DataFrame:
    """The aliases as steps (state, word, next_state, concept_id): a state is the words read so far, '' before the first.

    Only the step that completes an alias has its concept.  An alias with several steps shares those of its beginning with others.
    """
    keys = check_aliases(aliases).select("concept_id", F.split("alias_key", " ").alias("w"))
    steps = keys.select("concept_id", F.size("w").alias("n"), "w", F.explode(F.sequence(F.lit(1), F.size("w"))).alias("k")).select(
        F.array_join(F.slice("w", F.lit(1), F.col("k") - 1), " ").alias("state"), F.element_at("w", F.col("k")).alias("word"),
        F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("next_state"), F.when(F.col("k") == F.col("n"), F.col("concept_id")).alias("concept_id"))
    return steps.groupBy("state", "word", "next_state").agg(F.max("concept_id").alias("concept_id"))


@operator("route_questions")
def route_questions(questions: DataFrame, aliases: DataFrame) -> DataFrame:
    """Concepts named in each question: longest spans first, no overlaps.

    Every word starts a walk through the trie of the aliases; a level joins the walks that are alive with their question's
    next word and the steps from their state, and a walk that no alias continues is gone.  The walks end with the last
    alive one, so a long alias costs only the walks that follow it.  Completed aliases are settled per question by a fold.
    """
    need_columns(questions, ["question_id", "question"])
    trie = cut_lineage(alias_trie(aliases))
    words = questions.select("question_id", F.posexplode(F.transform(word_list(F.col("question")), F.lower)).alias("p", "word"))
    words = cut_lineage(words.withColumn("p", F.col("p") + 1))
    walks = words.select("question_id", F.col("p").alias("start"), F.col("p").alias("at"), F.lit("").alias("state"))
    ended, length = None, 0
    while True:
        length += 1
        walks = cut_lineage(walks.join(words.withColumnRenamed("p", "at"), ["question_id", "at"]).join(trie, ["state", "word"]).select(
            "question_id", "start", (F.col("at") + 1).alias("at"), F.col("next_state").alias("state"), "concept_id"))
        done = walks.filter(F.col("concept_id").isNotNull()).select("question_id", "start", F.lit(length).alias("length"), "concept_id")
        ended = done if ended is None else ended.unionByName(done)
        walks = walks.drop("concept_id")
        if walks.isEmpty():
            break
    met = ended.groupBy("question_id").agg(F.sort_array(F.collect_list(F.struct(
        (-F.col("length")).alias("o"), "start", "length", "concept_id"))).alias("spans"))
    none = F.array().cast("array<struct<o:int,start:int,length:int,concept_id:string>>")

    def settle(taken: Column, s: Column) -> Column:
        free = ~F.exists(taken, lambda t: (t["start"] < s["start"] + s["length"])
                         & (s["start"] < t["start"] + t["length"]))
        return F.when(free, F.concat(taken, F.array(s))).otherwise(taken)

    chosen = F.aggregate("spans", none, settle)
    return met.select("question_id", F.array_distinct(F.transform(chosen, lambda t: t["concept_id"])).alias("concept_ids"))


@operator("roam_concepts")
def roam_concepts(routes: DataFrame, relations: DataFrame, relation_types: list[str], max_depth: int = 1,
                  max_concepts: int = 10, known: DataFrame | None = None) -> DataFrame:
    """Breadth-first walk from the routed concepts, level by level.

    One row per question and concept reached: order, depth, and the step that
    led there.  A level is a join of the frontier with the relations; the order
    within it is that of a queue (parent, relation type, relation position).
    """
    need_columns(routes, ["question_id", "concept_ids"])
    need_columns(relations, ["from_concept_id", "to_concept_id", "relation_type", "position"])
    need_some(relation_types, "relation type")
    unknown = set(relation_types) - set(RELATION_TYPES)
    if unknown:
        raise ValueError(f"unknown relation types: {sorted(unknown)}")
    text = lambda name: F.lit(None).cast("string").alias(name)
    seeds = routes.select("question_id", F.posexplode("concept_ids").alias("p", "concept_id"))
    if known is not None:
        seeds = seeds.join(known.select("concept_id").distinct(), "concept_id", "left_semi")
    w = Window.partitionBy("question_id").orderBy("p")
    seen = (seeds.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= max_concepts)
            .select("question_id", "concept_id", F.col("place").cast("bigint").alias("place"), F.lit(0).alias("depth"),
                    text("from_concept_id"), text("relation_type")))
    seen = cut_lineage(seen)
    kind = F.array_position(F.array(*[F.lit(t) for t in relation_types]), F.col("relation_type"))
    edges = relations.filter(F.col("relation_type").isin(*relation_types)).select(
        "from_concept_id", F.col("to_concept_id").alias("concept_id"), "relation_type", "position", kind.alias("kind"))
    for depth in range(1, max_depth + 1):
        front = seen.filter(F.col("depth") == depth - 1).select(
            "question_id", F.col("concept_id").alias("from_concept_id"), F.col("place").alias("parent"))
        order = [F.asc(c) for c in ("parent", "kind", "position")]
        found = front.join(edges, "from_concept_id").join(
            seen.select("question_id", "concept_id"), ["question_id", "concept_id"], "left_anti")
        found = keep_one_per_key(found, [F.col("question_id"), F.col("concept_id")], order)
        taken = seen.groupBy("question_id").agg(F.count(F.lit(1)).alias("taken"))
        w = Window.partitionBy("question_id").orderBy(*order)
        ranked = found.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= max_concepts)
        new = (ranked.join(taken, "question_id").withColumn("place", F.col("__r") + F.col("taken"))
               .filter(F.col("place") <= max_concepts)
               .select("question_id", "concept_id", "place", F.lit(depth).alias("depth"), "from_concept_id",
                       "relation_type"))
        seen = cut_lineage(seen.unionByName(new))
    return seen


@operator("assemble_citations")
def assemble_citations(hits: DataFrame, nodes: DataFrame, block_rows: int | None = None) -> DataFrame:
    """Evidence of the hits, best hit first, each (source_ref, locator) once."""
    need_columns(nodes, ["node_id", "evidence_refs"])
    refs = nodes.select("node_id", F.posexplode("evidence_refs").alias("ref_position", "r"))
    rows = hits.join(refs, "node_id").select("question_id", "node_id", "score", "ref_position",
                                             "r.source_ref", "r.locator")
    order = [F.desc("score"), F.asc("node_id"), F.asc("ref_position")]
    one = keep_one_per_key(rows, [F.col(c) for c in ("question_id", "source_ref", "locator")], order)
    out = number_rows(one, ["question_id"], [{"column": "score", "descending": True}, "node_id", "ref_position"],
                      "citation", block_rows)
    return out.select("question_id", "citation", "source_ref", "locator", "node_id")


@operator("navigate")
def navigate(questions: DataFrame, aliases: DataFrame, relations: DataFrame, nodes: DataFrame,
             relation_types: list[str], max_depth: int = 1, max_concepts: int = 10) -> dict[str, DataFrame]:
    """Route, roam, retrieve and cite; a question without a match drops out."""
    routes = route_questions(questions, aliases)
    scope = roam_concepts(routes, relations, relation_types, max_depth, max_concepts,
                          aliases.select("concept_id"))
    hits = retrieve_nodes(questions, scope, nodes)
    return {"routes": routes, "scope": scope, "hits": hits, "citations": assemble_citations(hits, nodes)}
