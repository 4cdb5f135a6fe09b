"""From signals and statements to gates, a decision card and position sizes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from loomtable.functions.checks import need_columns
from loomtable.operators.signals import _ladder
from loomtable.registry import operator

C = F.col
# Title words that flag a risk, and the words of good news.
DISCLOSURE_RISKS = ("减持", "问询", "诉讼", "终止", "风险提示", "预亏", "亏损")
DISCLOSURE_TOPICS = (("annual_report", ("年度报告", "年报")), ("dividend", ("利润分配", "分红")),
                     ("buyback", ("回购", "增持")))
# Words that make a risk note an event risk.
EVENT_RISKS = ("问询", "诉讼", "处罚", "减持", "违约", "退市", "爆雷", "亏损")


def _any_word(c: Column, words) -> Column:
    return reduce(Column.__or__, [c.contains(w) for w in words])


@operator("disclosure_flags")
def disclosure_flags(titles: DataFrame, key: str = "symbol", title: str = "title",
                     order: str = "position") -> DataFrame:
    """Per symbol: announcement count, risk words found and topics seen.

    Every word is one flag of a map-side combined aggregate, so a symbol with
    very many announcements costs no more than any other.
    """
    need_columns(titles, [key, title])
    t = C(title)
    hits = titles.groupBy(key).agg(
        F.count(F.lit(1)).alias("announcement_count"),
        *[F.max(t.contains(w)).alias(f"__r{i}") for i, w in enumerate(DISCLOSURE_RISKS)],
        *[F.max(_any_word(t, words)).alias(f"__t{i}") for i, (_, words) in enumerate(DISCLOSURE_TOPICS)])
    risks = F.array_compact(F.array(*[F.when(C(f"__r{i}"), w) for i, w in enumerate(DISCLOSURE_RISKS)]))
    topics = F.array_compact(F.array(*[F.when(C(f"__t{i}"), n) for i, (n, _) in enumerate(DISCLOSURE_TOPICS)]))
    return hits.select(key, F.lit("available").alias("disclosure_status"), "announcement_count",
                       risks.alias("disclosure_risks"), topics.alias("disclosure_topics"))


@operator("statement_signals")
def statement_signals(statements: DataFrame) -> DataFrame:
    """Growth signal and risk flags of the latest statement."""
    need_columns(statements, ["revenue_yoy_pct", "net_profit_yoy_pct", "roe_pct"])
    r, p = C("revenue_yoy_pct"), C("net_profit_yoy_pct")
    signal = _ladder((r.isNull() | p.isNull(), "unknown"), ((r >= 0) & (p >= 0), "positive"),
                     ((r < 0) & (p < 0), "negative"), otherwise="mixed")
    flags = F.array_compact(F.array(
        F.when(p < 0, "profit_falling"), F.when(r < 0, "revenue_falling"),
        F.when(C("roe_pct") < 8, "low_return_on_equity"), F.when(r.isNull() | p.isNull(), "growth_incomplete")))
    return statements.withColumn("profit_signal", signal).withColumn("statement_risks", flags)


@operator("integrated_stance")
def integrated_stance(context: DataFrame, statements: DataFrame, disclosures: DataFrame) -> DataFrame:
    """Technical alignment, statement and announcements in one stance; what is
    missing for a symbol counts as an information gap."""
    need_columns(context, ["symbol", "alignment"])
    rows = (context.join(statements, "symbol", "left").join(disclosures, "symbol", "left")
            .withColumn("statement_status", F.coalesce("statement_status", F.lit("unavailable")))
            .withColumn("disclosure_status", F.coalesce("disclosure_status", F.lit("unavailable")))
            .withColumn("profit_signal", F.when(C("statement_status") == "available",
                                                F.coalesce("profit_signal", F.lit("unknown"))).otherwise("unknown")))
    none = F.array().cast("array<string>")
    rows = rows.withColumns({c: F.coalesce(C(c), none) for c in ("disclosure_risks", "statement_risks")})
    gap = (C("statement_status") != "available") | (C("disclosure_status") != "available")
    risky, good = F.size("disclosure_risks") > 0, C("profit_signal") == "positive"
    stance = _ladder((gap, "technical_only"), ((C("alignment") == "tailwind") & good & ~risky, "constructive"),
                     ((C("alignment") == "mixed") & good & ~risky, "watchful_positive"),
                     ((C("alignment") == "headwind") | (C("profit_signal") == "negative") | risky, "cautious"),
                     otherwise="mixed_watch")
    return rows.withColumn("stance", stance)


@operator("evidence_quality")
def evidence_quality(rows: DataFrame) -> DataFrame:
    """Which sources are missing, and whether the evidence is complete."""
    gaps = F.array_compact(F.array(F.when(C("statement_status") != "available", "statement"),
                                   F.when(C("disclosure_status") != "available", "disclosure"),
                                   F.when(C("alignment") == "unavailable", "context")))
    return (rows.withColumn("data_gaps", gaps)
            .withColumn("evidence_status", F.when(F.size("data_gaps") == 0, "complete").otherwise("degraded")))


@operator("risk_gates")
def risk_gates(rows: DataFrame, stop_loss_pct: float, target_return_pct: float, min_risk_reward: float) -> DataFrame:
    """Five gates as an array of structs (gate, result, blocking)."""
    need_columns(rows, ["as_of_date", "alignment", "data_gaps", "evidence_status", "disclosure_risks"])
    notes = F.concat(F.coalesce("statement_risks", F.array().cast("array<string>")), C("disclosure_risks"))
    events = F.size(F.filter(notes, lambda n: _any_word(n, EVENT_RISKS)))
    ratio = 0.0 if stop_loss_pct <= 2.220446049250313e-16 else target_return_pct / stop_loss_pct
    dated, paid = C("as_of_date").isNotNull(), F.lit(ratio >= min_risk_reward)
    gate = lambda name, result, blocking: F.struct(F.lit(name).alias("gate"), result.alias("result"),
                                                   blocking.alias("blocking"))
    warn = lambda test: F.when(test, "warn").otherwise("pass")
    fail = lambda ok: F.when(ok, "pass").otherwise("fail")
    no = F.lit(False)
    return rows.withColumn("event_risk_count", events).withColumn("gates", F.array(
        gate("analysis_date_gate", fail(dated), ~dated),
        gate("data_completeness_gate", warn(F.size("data_gaps") > 0), no),
        gate("market_alignment_gate", warn(C("alignment") != "tailwind"), no),
        gate("event_risk_gate", warn((events > 0) | (C("evidence_status") != "complete")), no),
        gate("risk_reward_gate", fail(paid), ~paid)))


def _one_decimal(value: float) -> float:
    return float(f"{value * 100.0:.1f}") / 100.0


@operator("decision_card")
def decision_card(rows: DataFrame, stop_loss_pct: float, target_return_pct: float) -> DataFrame:
    """Status, direction and confidence of each symbol."""
    need_columns(rows, ["gates", "evidence_status", "alignment", "stance"])
    warns = F.size(F.filter("gates", lambda g: g["result"] == "warn"))
    stopped = F.exists("gates", lambda g: g["blocking"] & (g["result"] == "fail"))
    partial = C("evidence_status") != "complete"
    status = _ladder((stopped, "blocked"), (partial | (warns > 0), "needs_more_evidence"), otherwise="ready_for_review")
    base = _ladder((C("stance") == "positive", 0.78), (C("stance") == "watchful_positive", 0.66),
                   (C("stance") == "neutral", 0.52), otherwise=0.35)
    score = (base + F.when(C("alignment") == "tailwind", 0.08).otherwise(0.0) - F.when(partial, 0.08).otherwise(0.0)
             - warns * 0.05 - F.when(stopped, 0.15).otherwise(0.0))
    return rows.withColumns({
        "warn_count": warns, "status": status,
        "direction": F.when(C("stance").isin("negative", "watchful_negative", "bearish"), "avoid").otherwise("long"),
        "confidence_score": F.least(F.greatest(score, F.lit(0.0)), F.lit(0.95)),
        "position_size": _ladder((status == "blocked", "none"), (status == "needs_more_evidence", "pilot"),
                                 otherwise="starter"),
        "downside_risk": F.lit(_one_decimal(stop_loss_pct)),
        "first_target": F.lit(_one_decimal(target_return_pct)),
        "second_target": F.lit(_one_decimal(target_return_pct * 1.5))})


@operator("position_plan")
def position_plan(cards: DataFrame) -> DataFrame:
    """Sizes by status, confidence and open warnings."""
    need_columns(cards, ["status", "confidence_score", "warn_count"])
    blocked, probe = C("status") == "blocked", C("status") == "needs_more_evidence"
    size = F.when(C("confidence_score") >= 0.80, 0.12).otherwise(0.10) - F.when(C("warn_count") > 0, 0.02).otherwise(0.0)
    by = lambda a, b, c: F.when(blocked, a).when(probe, b).otherwise(c)
    return cards.withColumns({
        "plan_status": by("blocked", "probe_only", "reviewable"), "suggested_gross_pct": by(0.0, 0.05, size),
        "starter_gross_pct": by(0.0, 0.03, F.when(size >= 0.10, 0.06).otherwise(0.05)),
        "max_gross_pct": by(0.0, 0.05, F.least(size + 0.03, F.lit(0.15))),
        "risk_budget_pct": by(0.0, 0.005, 0.01), "allow_add": ~blocked & ~probe,
        "entry_mode": by("disabled", "probe", "staged")})


@operator("security_decision")
def security_decision(context: DataFrame, statements: DataFrame, disclosures: DataFrame, stop_loss_pct: float,
                      target_return_pct: float, min_risk_reward: float) -> DataFrame:
    """Stance, evidence, gates, card and position plan of every symbol."""
    rows = evidence_quality(integrated_stance(context, statements, disclosures))
    rows = risk_gates(rows, stop_loss_pct, target_return_pct, min_risk_reward)
    return position_plan(decision_card(rows, stop_loss_pct, target_return_pct))
