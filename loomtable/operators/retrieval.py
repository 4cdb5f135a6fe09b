"""Scoped retrieval over blocks of nodes.

The index lists the nodes of each concept in blocks of bounded size.  A block holds nodes of like richness (number of distinct words),
so that a question's score in a block is at most the smaller of two numbers: how many of its words occur in the block at all, and how
rich the block's richest node is.  A top-k search looks into a question's most promising blocks first; the k-th score found there is a
floor, and blocks whose bound stays below it are never opened.  An opened block answers up to ``CHUNK`` questions at once and
sends back at most k nodes for each, so what is shuffled grows with questions, opened blocks and k, not with the pairs that share
a word.  No key is larger than a block: hot concepts have many blocks, common words are only looked up inside them.

An index that is made for known questions keeps only words that one of them may hold, by one bit per word in a summary of fixed size: two
words may share a bit, which keeps a word too many and changes no score.  Such an index is a small part of the texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from loomtable.functions.checks import need_columns
from loomtable.functions.texts import word_set
from loomtable.registry import operator
from loomtable.session import beside_large, cut_lineage, stored

BLOCK, CHUNK, FIRST_BLOCKS = 256, 256, 2
#: numbers of 64 bits in the summary of the asked words; words of the nodes that one task lists block by block
SLOTS, PART_WORDS = 1 << 14, 1 << 21
_PLACE = ["concept_id", "block"]


@operator("node_blocks")
def node_blocks(nodes: DataFrame, block_nodes: int = BLOCK, asked: DataFrame | None = None) -> DataFrame:
    """concept_id, block, richest, node_id, words: the nodes of each concept in blocks of about ``block_nodes``.

    Nodes are sorted into two classes per doubling of their number of words, and each class of a concept is dealt into
    blocks by the fingerprint of the node id.  The words are read once and the rows are written out.  With ``asked`` (lists of ``words``) other
    words may be left out, and nodes with none of them; the index then serves these questions only.
    """
    need_columns(nodes, ["node_id", "title", "body", "concept_ids"])
    if block_nodes < 1:
        raise ValueError("block_nodes must be positive")
    # one shuffle spreads the reading of words, however few files hold the nodes
    held = nodes.select("node_id", "title", "body", "concept_ids").repartition("node_id").select(
        "node_id", F.array_distinct("concept_ids").alias("concepts"), word_set(F.concat_ws(" ", "title", "body")).alias("words"))
    if asked is not None:
        may = lambda w: F.getbit(F.get("bits", _slot(w)), _bit(w)) == 1
        held = held.crossJoin(F.broadcast(_summary(asked))).select("node_id", "concepts", F.filter("words", may).alias("words"))
    # an outer explode keeps the tokenising below it from being repeated in filters
    rows = held.select("node_id", "words", F.size("words").alias("n"), F.explode_outer("concepts").alias("concept_id"))
    rows = stored(rows).filter((F.col("n") > 0) & F.col("concept_id").isNotNull()).withColumn("kind", F.floor(F.log2("n") * 2))
    classes = cut_lineage(rows.groupBy("concept_id", "kind").agg(F.ceil(F.count(F.lit(1)) / block_nodes).alias("blocks"), F.max("n").alias("richest")))
    block = F.struct(F.col("kind"), F.pmod(F.xxhash64("node_id"), F.col("blocks")).alias("part"))
    return rows.join(beside_large(classes), ["concept_id", "kind"]).select("concept_id", block.alias("block"), "richest", "node_id", "words")


def _slot(word: Column) -> Column:
    return F.pmod(F.hash(word), F.lit(SLOTS))


def _bit(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(64)).cast("int")


def _summary(asked: DataFrame) -> DataFrame:
    """One row: ``SLOTS`` numbers that have the bits of all words set."""
    word = F.col("word")
    some = asked.select(F.explode("words").alias("word")).select(
        _slot(word).alias("slot"), F.call_function("shiftleft", F.lit(1).cast("bigint"), _bit(word)).alias("bits"))
    every = asked.sparkSession.range(SLOTS).select(F.col("id").cast("int").alias("slot"), F.lit(0).cast("bigint").alias("bits"))
    each = some.unionByName(every).groupBy("slot").agg(F.bit_or("bits").alias("bits"))
    return each.agg(F.sort_array(F.collect_list(F.struct("slot", "bits"))).alias("s")).select(F.col("s.bits").alias("bits"))


def _scored(index: DataFrame, wanted: DataFrame, top_k: int | None) -> DataFrame:
    """question_id, node_id, score of the wanted (concept_id, block, chunk, question_id, words, floor).

    A group is one block and one chunk of questions.  Only scores of at least the floor leave it, at most ``top_k`` a question.
    """
    chunks = wanted.select(*_PLACE, "chunk").distinct()
    held = index.select(*_PLACE, "node_id", "words").join(beside_large(chunks), _PLACE).select(*_PLACE, "chunk", "node_id", "words")
    kinds = {"question_id": wanted.schema["question_id"].dataType.simpleString(), "node_id": index.schema["node_id"].dataType.simpleString()}

    def run(nodes: pa.Table, questions: pa.Table) -> pa.Table:
        nodes, questions = nodes.combine_chunks(), questions.combine_chunks()
        asked, words = (t.column("words").combine_chunks() for t in (questions, nodes))
        vocabulary = pc.unique(asked.flatten())
        table = np.zeros((len(vocabulary), nodes.num_rows), np.float32)
        row, at = _cells(words, vocabulary)
        table[at, row] = 1
        ask = np.zeros((questions.num_rows, len(vocabulary)), np.float32)
        row, at = _cells(asked, vocabulary)
        ask[row, at] = 1
        scores = (ask @ table).astype(np.int64)
        floor = np.maximum(questions.column("floor").to_numpy(), 1)
        question, node = np.nonzero(scores >= floor[:, None])
        out = pa.table({"no": question, "node_id": nodes.column("node_id").take(pa.array(node)), "score": scores[question, node]})
        if top_k is not None:
            out = out.sort_by([("no", "ascending"), ("score", "descending"), ("node_id", "ascending")])
            no = out.column("no").to_numpy()
            out = out.filter(pa.array(np.arange(len(no)) - np.searchsorted(no, no) < top_k))
        return pa.table({"question_id": questions.column("question_id").take(out.column("no")), "node_id": out.column("node_id"), "score": out.column("score")})

    keys = [*_PLACE, "chunk"]
    asking = wanted.select(*[F.col(k).alias(f"asked_{k}") for k in keys], "question_id", "words", "floor")
    both = held.groupBy(*keys).cogroup(asking.groupBy(*[f"asked_{k}" for k in keys]))
    return both.applyInArrow(run, f"question_id {kinds['question_id']}, node_id {kinds['node_id']}, score bigint")


def _cells(lists: pa.ListArray, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, place in the vocabulary) of the listed words that are in it."""
    row = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    at = pc.index_in(lists.flatten(), value_set=vocabulary)
    there = at.is_valid().to_numpy(zero_copy_only=False)
    return row[there], at.drop_null().to_numpy()


def _best(hits: DataFrame, top_k: int) -> DataFrame:
    best = Window.partitionBy("question_id").orderBy(F.desc("score"), "node_id")
    return hits.withColumn("__r", F.row_number().over(best)).filter(F.col("__r") <= top_k)


@operator("retrieve_nodes")
def retrieve_nodes(questions: DataFrame, scope: DataFrame, nodes: DataFrame, top_k: int | None = None, index: DataFrame | None = None) -> DataFrame:
    """Nodes of the concepts in scope, scored by shared words; no zero scores.

    With ``top_k`` only the best nodes of a question come back (ties by id); without it every node that shares a word does.
    ``index`` is a result of ``node_blocks`` to be used instead of the nodes.  A node of several concepts in scope counts once.
    """
    need_columns(questions, ["question_id", "question"])
    need_columns(scope, ["question_id", "concept_id"])
    asked = questions.select("question_id", word_set(F.coalesce("question", F.lit(""))).alias("words"))
    blocks = node_blocks(nodes, asked=asked) if index is None else index
    # questions of a chunk meet a block together; their number per chunk is about CHUNK
    chunks = F.greatest(F.lit(1), F.ceil(F.lit(questions.count() / CHUNK)))
    wanted = scope.select("question_id", "concept_id").distinct().join(asked.filter(F.size("words") > 0), "question_id")
    wanted = cut_lineage(wanted.withColumn("chunk", F.pmod(F.xxhash64("question_id"), chunks)))
    listed = ["question_id", "concept_id", "block", "chunk", "words", "floor"]
    if top_k is None:
        places = blocks.select(*_PLACE).distinct()
        found = _scored(blocks, places.join(wanted, "concept_id").withColumn("floor", F.lit(1).cast("bigint")).select(listed), None)
        return found.groupBy("question_id", "node_id").agg(F.max("score").alias("score"))

    pairs = cut_lineage(_bounds(blocks, wanted))
    place: list[Column] = [F.desc("bound"), F.asc("block")]
    ranked = pairs.withColumn("__r", F.row_number().over(Window.partitionBy("question_id").orderBy(*place, "concept_id")))
    seeds = ranked.filter(F.col("__r") <= FIRST_BLOCKS).withColumn("floor", F.lit(1).cast("bigint"))
    keyed = wanted.select("question_id", "concept_id", "chunk", "words")
    first = cut_lineage(_scored(blocks, seeds.join(keyed, ["question_id", "concept_id"]).select(listed), top_k).dropDuplicates(["question_id", "node_id"]))
    floors = _best(first, top_k).filter(F.col("__r") == top_k).select("question_id", F.col("score").alias("kth"))
    rest = (pairs.join(seeds.select("question_id", *_PLACE), ["question_id", *_PLACE], "left_anti").join(floors, "question_id", "left")
            .withColumn("floor", F.coalesce("kth", F.lit(1).cast("bigint"))).filter(F.col("bound") >= F.col("floor")))
    more = _scored(blocks, rest.join(keyed, ["question_id", "concept_id"]).select(listed), top_k)
    return _best(first.unionByName(more).dropDuplicates(["question_id", "node_id"]), top_k).drop("__r")


def _bounds(blocks: DataFrame, wanted: DataFrame) -> DataFrame:
    """question_id, concept_id, block, bound: no node of the block shares more words with the question.

    The rows of a block are brought together before their words are listed, so that a word leaves a block once; the parts grow in number
    with the words and not in size.
    """
    listed = blocks.agg(F.sum(F.size("words"))).first()[0] or 0
    parts = max(blocks.sparkSession.sparkContext.defaultParallelism, -(-listed // PART_WORDS))
    asked = wanted.select("question_id", "concept_id", F.explode("words").alias("word"))
    words = (blocks.repartition(parts, *_PLACE).select(*_PLACE, "richest", F.explode("words").alias("word"))
             .join(beside_large(asked.select("concept_id", "word").distinct()), ["concept_id", "word"], "left_semi").distinct())
    return (words.join(beside_large(asked), ["concept_id", "word"]).groupBy("question_id", *_PLACE)
            .agg(F.least(F.count(F.lit(1)), F.max("richest")).alias("bound")))
