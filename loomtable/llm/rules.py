"""Quality rules whose thresholds come from the data: DataFrame functions only.

Every text is measured once.  The measures of texts that pass the base rules go into mergeable quantile
sketches, one per language, source and measure: log-linear histograms of whole numbers (exact below 128, 1/64
relative width above), so two sketches merge by adding counts and any grouping of the rows gives the same sketch.
A threshold is a quartile plus or minus three times the quartile distance, at least the measure's slack.  A group with fewer
than ``min_group`` texts takes the sketch merged over its language, then over everything.  Thresholds are
joined to the measured rows, and a text outside any of them is rejected.

Defined results: a null text counts as empty and fails; null languages and sources are groups of their own; rows are judged one by
one, so repeated rows and repeated ids each get a row; an empty table gives an empty result; no column
of the input other than the four named is read, and carried columns travel inside one struct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window

from loomtable.llm.tables import written

SPACE = r"[\x20\x09-\x0D]"
#: measure -> (numerator, denominator, slack per thousand, whether low values are rejected too)
MEASURES = {"symbols": ("n_symbols", "n_words", 100, False), "duplicate_lines": ("n_dup_lines", "n_lines", 500, False),
            "repeats": ("n_repeat_words", "n_words", 200, False), "capitals": ("n_upper", "word_chars", 100, False),
            "echoes": ("n_echoes", "n_words", 200, False), "word_length": ("word_chars", "n_words", 2500, True)}
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_echoes"]


def measured(docs: DataFrame, text_col: str, lang_col: str, source_col: str, carry: list[str]) -> DataFrame:
    """row (the carried columns), lang, source, the counts, base_failed."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    split = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), F.col(f"`{lang_col}`").alias("lang"),
        F.col(f"`{source_col}`").alias("source"), text.alias("text"),
        F.array_remove(F.split(text, SPACE + "+"), "").alias("words"),
        F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    # get() reads one element; slice() would copy the whole array for every position
    windows = F.when(F.size("words") >= 5, F.transform(
        F.sequence(F.lit(0), F.size("words") - 5),
        lambda i: F.xxhash64(*[F.get("words", i + j) for j in range(5)]))).otherwise(F.array().cast("array<bigint>"))
    hashed = split.select(
        "row", "lang", "source", F.size("words").cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", SPACE + "+", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        F.length(F.regexp_replace("text", r"[^\p{Lu}]+", "")).cast("long").alias("n_upper"),
        F.when(F.size("words") > 1, F.size(F.filter(
            F.sequence(F.lit(1), F.size("words") - 1), lambda i: F.get("words", i) == F.get("words", i - 1)))).otherwise(0)
        .cast("long").alias("n_echoes"),
        windows.alias("windows"))
    # only texts with a repeated window sort their windows, to see each next to its equals
    ordered = hashed.withColumn("ordered", F.when(
        F.size(F.array_distinct("windows")) < F.size("windows"),
        F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    equal = lambda a, b: F.get("ordered", a)["h"] == F.get("ordered", b)["h"]
    starts = F.sort_array(F.array_compact(F.transform(
        F.sequence(F.lit(0), F.size("ordered") - 1),
        lambda k: F.when(F.coalesce(equal(k, k - 1), F.lit(False)) | F.coalesce(equal(k, k + 1), F.lit(False)),
                         F.get("ordered", k)["i"]))))
    covered = F.aggregate(starts, F.struct(F.lit(-5).alias("last"), F.lit(0).alias("total")),
                          lambda a, s: F.struct(s.alias("last"), (a["total"] + F.least(F.lit(5), s - a["last"])).alias("total")),
                          lambda a: a["total"])
    counted = ordered.withColumn("n_repeat_words", F.when(F.col("ordered").isNull(), 0).otherwise(covered).cast("long"))
    return counted.select("row", "lang", "source", *COUNTS, (
        (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))).alias("base_failed"))


def rates() -> dict[str, Column]:
    """Each measure per thousand, a whole number."""
    return {m: F.expr(f"coalesce({top} * 1000 div nullif({bottom}, 0), 0L)") for m, (top, bottom, _, _) in MEASURES.items()}


def sketched(rows: DataFrame) -> DataFrame:
    """lang, source, measure, low (lower edge of the bucket), n: the sketches of rows that pass the base rules."""
    names = list(MEASURES)
    long = rows.filter("not base_failed").select("lang", "source", F.explode(F.map_from_arrays(
        F.array(*[F.lit(m) for m in names]), F.array(*[rates()[m] for m in names]))).alias("measure", "v"))
    shift = "greatest(length(bin(v)) - 7, 0)"
    return (long.withColumn("low", F.expr(f"shiftleft(shiftright(v, {shift}), {shift})"))
            .groupBy("lang", "source", "measure", "low").agg(F.count("*").alias("n")))


def merged(sketches: DataFrame, *by: str) -> DataFrame:
    """Sketches of coarser groups: the sums of the finer ones."""
    return sketches.groupBy(*by, "measure", "low").agg(F.sum("n").alias("n"))


def quartiles(sketches: DataFrame, *by: str) -> DataFrame:
    """by, measure, total, q1, q3; a group's sketch has a bounded number of buckets."""
    group = Window.partitionBy(*by, "measure")
    placed = sketches.select("*", F.sum("n").over(group).alias("total"),
                             F.sum("n").over(group.orderBy("low").rowsBetween(Window.unboundedPreceding, 0)).alias("upto"))
    return placed.groupBy(*by, "measure").agg(
        F.max("total").alias("total"), F.min(F.when(F.col("upto") * 4 >= F.col("total"), F.col("low"))).alias("q1"),
        F.min(F.when(F.col("upto") * 4 >= 3 * F.col("total"), F.col("low"))).alias("q3"))


def thresholds(sketches: DataFrame, min_group: int) -> DataFrame:
    """lang, source, and lo_, hi_ of each measure."""
    fine = quartiles(sketches, "lang", "source")
    by_lang = quartiles(merged(sketches, "lang"), "lang").select(
        F.col("lang").alias("l_lang"), F.col("measure").alias("l_measure"), F.struct("total", "q1", "q3").alias("l"))
    everything = quartiles(merged(sketches)).select(F.col("measure").alias("a_measure"), F.struct("total", "q1", "q3").alias("a"))
    joined = (fine.join(by_lang, F.col("lang").eqNullSafe(F.col("l_lang")) & (F.col("measure") == F.col("l_measure")))
              .join(everything, F.col("measure") == F.col("a_measure")))
    own = F.struct("total", "q1", "q3")
    used = joined.select("lang", "source", "measure", F.when(F.col("total") >= min_group, own).when(
        F.col("l.total") >= min_group, F.col("l")).otherwise(F.col("a")).alias("q"))
    slack = F.create_map(*[F.lit(x) for m, (_, _, s, _) in MEASURES.items() for x in (m, s)])
    reach = F.greatest(3 * (F.col("q.q3") - F.col("q.q1")), slack[F.col("measure")].cast("long"))
    fences = used.select("lang", "source", "measure", (F.col("q.q1") - reach).alias("lo"), (F.col("q.q3") + reach).alias("hi"))
    at = lambda m, c: F.max(F.when(F.col("measure") == m, F.col(c)))
    return fences.groupBy("lang", "source").agg(*[at(m, c).alias(f"{c}_{m}") for m in MEASURES for c in ("lo", "hi")])


def judged(docs: DataFrame, carry: list[str], text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
           min_group: int = 200) -> DataFrame:
    """row, the counts, base_failed, kept for every row.

    The measured rows are written once, so texts are split once.  The thresholds are a written table with one row
    per language and source: Spark sees its size and sends it to every task, or shuffles the narrow rows if it is large."""
    rows = written(measured(docs, text_col, lang_col, source_col, carry))
    limits = written(thresholds(sketched(rows), min_group)).withColumnsRenamed({"lang": "t_lang", "source": "t_source"})
    joined = rows.join(limits, F.col("lang").eqNullSafe(F.col("t_lang")) & F.col("source").eqNullSafe(F.col("t_source")), "left")
    inside = F.lit(True)
    for m, (_, _, _, low) in MEASURES.items():
        inside &= rates()[m] <= F.col(f"hi_{m}")
        if low:
            inside &= rates()[m] >= F.col(f"lo_{m}")
    kept = ~F.col("base_failed") & F.coalesce(inside, F.lit(True))
    return joined.select("row", *COUNTS, "base_failed", kept.alias("kept"))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", **names) -> DataFrame:
    """id, the counts, base_failed, kept."""
    out = judged(docs, [id_col], **names)
    return out.select(F.col("row").getField(id_col).alias(id_col), *COUNTS, "base_failed", "kept")


def passing(docs: DataFrame, **names) -> DataFrame:
    """The rows of the table that the rules keep, with its own columns."""
    return judged(docs, docs.columns, **names).filter("kept").select("row.*")
