import collections
import datetime
import math
import re

import pytest
from pyspark.errors import PySparkException

from conftest import column, rows
from loomtable.operators.capacity import (capacity_assessment, capacity_from_inventory, latest_metrics, matched_processes,
                                          parse_inventory)
from loomtable.operators.concepts import (assemble_citations, check_aliases, navigate, retrieve_nodes, roam_concepts,
                                          route_questions)
from loomtable.operators.masking import mask_values
from loomtable.operators.recall import recall_situations
from loomtable.operators.reports import capacity_report_tables, diagnostics_report_tables
from loomtable.operators.statistics import diagnostics_report

NODE = ("node_id string, title string, body string, concept_ids array<string>, "
        "evidence_refs array<struct<source_ref:string,locator:string>>")
RELATION = "from_concept_id string, to_concept_id string, relation_type string, position bigint"


@pytest.fixture
def graph(frame):
    aliases = frame("concept_id string, alias string", ("pump", "Pump"), ("pump", "impeller"), ("seal", "Seal"),
                    ("power", "Motor"), ("heat", "Heat"), ("hot_pump", "pump heat"))
    relations = frame(RELATION, ("pump", "seal", "depends_on", 0), ("pump", "power", "supports", 1),
                      ("seal", "heat", "references", 2))
    nodes = frame(NODE, ("n1", "Pump manual", "Impeller wear shows as noise and a worn pump seal.", ["pump"], [("manual", "p4")]),
                  ("n2", "Heat log", "Pump heat per shift, heat alarms listed.", ["heat", "pump"], [("log", "r9"), ("manual", "p4")]),
                  ("n3", "Impeller wear budget", "Wear of each impeller, money only.", ["budget"], []))
    return aliases, relations, nodes


def test_routing_prefers_long_spans(frame, graph):
    q = frame("question_id int, question string", (1, "Is PUMP, heat up after the Impeller swap?"), (2, "no match"),
              (3, "impeller pump"), (4, None))
    got = {r.question_id: r.concept_ids for r in route_questions(q, graph[0]).collect()}
    assert got == {1: ["hot_pump", "pump"], 3: ["pump"]}
    with pytest.raises(PySparkException, match="given twice"):
        check_aliases(frame("concept_id string, alias string", ("x", " Motor"), ("y", "motor"))).collect()


@pytest.mark.parametrize("kinds,depth,most,want", [
    (["depends_on"], 1, 4, ["pump", "seal"]), (["depends_on", "supports"], 1, 2, ["pump", "seal"]),
    (["supports", "depends_on"], 1, 9, ["pump", "power", "seal"]),
    (["depends_on", "references"], 2, 9, ["pump", "seal", "heat"]), (["depends_on"], 0, 9, ["pump"])])
def test_roaming(frame, graph, kinds, depth, most, want):
    routes = frame("question_id int, concept_ids array<string>", (1, ["pump", "nobody"]))
    out = roam_concepts(routes, graph[1], kinds, depth, most, graph[0].select("concept_id"))
    assert column(out, "concept_id", "place") == want
    if "heat" in want:
        assert tuple(out.filter("concept_id = 'heat'").first()) == (1, "heat", 3, 2, "seal", "references")


def test_retrieval_and_citations(frame, graph):
    q = frame("question_id int, question string", (1, "impeller noise"), (2, "pump heat shift"), (3, "cash"))
    scope = frame("question_id int, concept_id string", (1, "pump"), (2, "pump"), (2, "heat"), (3, "pump"))
    hits = retrieve_nodes(q, scope, graph[2])
    assert sorted(rows(hits)) == [(1, "n1", 2), (2, "n1", 1), (2, "n2", 3)]
    assert sorted(rows(retrieve_nodes(q, scope, graph[2], top_k=1))) == [(1, "n1", 2), (2, "n2", 3)]
    for block in (None, 1):
        cited = rows(assemble_citations(hits, graph[2], block), "question_id", "citation")
        assert [(r[0], r[1], r[2]) for r in cited] == [(1, 1, "manual"), (2, 1, "log"), (2, 2, "manual")]
    out = navigate(q, *graph[:2], graph[2], ["depends_on"], 1, 4)
    assert column(out["routes"], "question_id", "question_id") == [1, 2]
    assert out["hits"].filter("node_id = 'n3'").count() == 0


def test_recall_against_a_plain_model(frame):
    texts = ["rates rise and tech falls", "oil rises on supply fear fear", "tech rallies as rates fall", "rates rates rates", ""]
    asked = ["will rates fall for tech", "zebra"]
    docs = [re.findall(r"\w+", t.lower()) for t in texts]
    n, avg = len(docs), sum(map(len, docs)) / len(docs)
    df = collections.Counter(w for d in docs for w in set(d))
    idf = {w: math.log(n - f + 0.5) - math.log(f + 0.5) for w, f in df.items()}
    eps = 0.25 * sum(idf.values()) / len(idf)
    idf = {w: x if x >= 0 else eps for w, x in idf.items()}

    def score(q, d):
        c = collections.Counter(d)
        return sum(idf.get(w, 0) * c[w] * 2.5 / (c[w] + 1.5 * (0.25 + 0.75 * len(d) / avg)) for w in re.findall(r"\w+", q))

    memories = frame("memory_id int, text string", *enumerate(texts))
    got = recall_situations(memories, frame("situation_id int, text string", *enumerate(asked)), 4)
    for i, q in enumerate(asked):
        scores = [score(q, d) for d in docs]
        best = sorted(range(n), key=lambda j: (-scores[j], j))[:4]
        mine = got.filter(f"situation_id = {i}").orderBy("rank").collect()
        assert [r.memory_id for r in mine] == best
        assert [r.score for r in mine] == pytest.approx([scores[j] for j in best])
        assert [r.similarity_score for r in mine] == pytest.approx([scores[j] / (max(scores) or 1) for j in best])


def test_capacity_needs_and_gaps(frame):
    df = frame("service string, r int, instances string, cpu_usage string, memory_usage string", ("mail", 3, "10", "0.35", "0.9"))
    out = capacity_assessment(df, "service", "r", target_cpu=0.5, target_memory=0.6, peak_multiplier=1.5, growth_rate=0.1).first()
    assert (out.evidence_level, out.capacity_status, out.limiting_resource) == ("quantified", "insufficient", "memory")
    assert out.recommended_instance_count == math.ceil(10 * 1.5 * 1.1 * (0.9 / 0.6) ** 1.35)
    spare = capacity_assessment(df, "service", "r", target_cpu=0.5, target_memory=0.6, peak_multiplier=1.5, growth_rate=0.1,
                                require_n_plus_one=True).first()
    assert spare.recommended_instance_count == out.recommended_instance_count + 1
    bare = capacity_assessment(frame("service string, r int, remark string", ("q", 0, "-")), "service", "r").first()
    assert bare.evidence_level == "guidance_only" and len(bare.missing_inputs) == 7


def test_capacity_history_and_profiles(frame):
    df = frame("s string, r int, ts string, instances string, cpu_usage string, workload_qps string", *[
        ("feed", i, f"2025-11-0{3 + i} 00:00", "6", c, q) for i, (c, q) in enumerate([("0.40", "80"), ("0.45", "95"), ("0.60", "140")])])
    out = capacity_assessment(df, "s", "r", growth_rate=0.25).first()
    assert out.cpu_direction == "upward" and out.history_metrics == ["cpu", "workload"] and out.evidence_level == "partial"
    assert out.cpu_demand == pytest.approx(1.25 * (1 + ((0.60 - 0.40) / 0.40) ** 1.1 * 0.25))
    only_cpu = frame("service string, r int, cpu_usage string, latency_p95_ms string", ("cart", 0, "0.9", "35"))
    profile = frame("service string, service_tier string, peak_pattern string, failure_impact string, current_instance_count int, "
                    "redundancy_mode string, scaling_step int", ("cart", "important", "burst", "critical", 7, "n_plus_one", 5))
    out = capacity_assessment(only_cpu, "service", "r", profile, target_cpu=0.6, peak_multiplier=1.3, growth_rate=0.05).first()
    need = math.ceil(7 * 1.3 * 1.05 * 1.05 * 1.1 * 1.08 * (0.9 / 0.6) ** 1.35) + 1
    assert out.recommended_instance_count == -(-need // 5) * 5
    assert (out.evidence_level, out.instance_source) == ("partial", "deployment_profile")


def test_latest_row_rules(frame):
    df = frame("s string, r int, ts string, instances string, cpu string, qps string", ("a", 1, "t1", "3", "50%", None),
               ("a", 2, "t9", None, None, "7"), ("a", 3, "t1", None, "1,000", None), ("b", 4, None, "5", None, None), ("c", 5, "t", None, None, None))
    got = {r.service: (r.instances, r.cpu, r.workload) for r in latest_metrics(df, "s", "r").collect()}
    assert got == {"a": (None, 1000.0, None), "b": (5.0, None, None), "c": (None, None, None)}


def test_inventory(frame):
    outputs = frame("service string, host string, command string, output string", ("pay", "h1", "hostname", " box-1 \n"),
                    ("pay", "h1", "nproc", "8\n"), ("pay", "h1", "free -m", "      total\n  Mem:  16000 1\nSwap: 1"),
                    ("pay", "h1", "ps -ef", "UID\n" + "\n".join(f"root java pay-{i}" for i in range(20))), ("web", "h2", "ps -ef", "init"),
                    ("web", "h2", "nproc", "many"))
    facts = {r.host: r for r in parse_inventory(outputs).collect()}
    assert (facts["h1"].hostname, facts["h1"].cpu_core_count, facts["h1"].memory_total_mb) == ("box-1", 8, 16000)
    assert facts["h1"].process_excerpt.count("\n") == 11 and facts["h2"].cpu_core_count is None
    assert rows(matched_processes(outputs, ["java"], ["service"]), "service") == [("pay", 20), ("web", None)]
    metrics = frame("service string, r int, cpu string, memory string", ("pay", 1, "0.9", "0.2"), ("web", 2, "0.9", "0.2"))
    out = {r.service: r for r in capacity_from_inventory(metrics, "service", "r", outputs, ["java"]).collect()}
    assert out["pay"].instance_source == "inventory_evidence" and out["pay"].current_instance_count == 20
    assert out["web"].evidence_level == "guidance_only"
    tables = capacity_report_tables(capacity_assessment(metrics, "service", "r"))
    assert set(tables) == {"conclusion", "resources", "evidence", "actions"}
    assert tables["resources"].count() == 0 and tables["actions"].filter("action = 'next_step'").count() == 2


def test_diagnostics_tables(frame):
    report = diagnostics_report(frame("a double, b double", *[(float(i), float(-i)) for i in range(6)]),
                                correlation={"target_column": "a", "feature_columns": ["b"]}, distribution={"column": "zzz"})
    t = diagnostics_report_tables(report)
    assert rows(t["correlation_outlier"]) == [("correlation", "strongest_negative:b", "-1.0000")]
    assert rows(t["distribution_trend"]) == [("distribution", "status", "unavailable")]
    assert column(t["summary"].filter("metric = 'report_status'"), "value") == ["degraded"]


def test_masks_follow_the_value(frame):
    df = frame("id int, who string, day date, pay double", (1, "ann", datetime.date(2024, 1, 5), 10.0), (2, "ann", None, 20.0),
               (3, None, datetime.date(2024, 1, 5), None), (4, "bob", datetime.date(2024, 1, 6), 30.0))
    words = frame("w string", ("red",), ("green",), ("blue",))
    rules = [{"column": "who", "kind": "word"}, {"column": "day", "kind": "shift_date", "key": "id", "span": 3},
             {"column": "pay", "kind": "scale_number", "key": "who", "spread": 0.5}]
    out = {r.id: r for r in mask_values(df, rules, "s", words).collect()}
    assert out[1].who == out[2].who in ("red", "green", "blue") and out[3].who is None
    assert out[2].pay == pytest.approx(2 * out[1].pay, abs=0.02) and 5 <= out[1].pay <= 15 and out[3].pay is None
    assert abs((out[1].day - datetime.date(2024, 1, 5)).days) <= 3 and out[2].day is None
    token = lambda salt: column(mask_values(df.select("who"), [{"column": "who", "kind": "token", "prefix": "p"}], salt), "who")
    assert token("a")[0] == token("a")[1] != token("b")[0] and token("a")[0] != token("a")[3] and len(token("a")[0]) == 17
    for bad, message in (({"column": "who", "kind": "zzz"}, "unknown"), ({"column": "day", "kind": "shift_date"}, "key"),
                         ({"column": "who", "kind": "word"}, "vocabulary")):
        with pytest.raises(ValueError, match=message):
            mask_values(df, [bad], "s")
