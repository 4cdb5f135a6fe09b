import math
import random
import statistics

import pytest
from pyspark.errors import PySparkException

from conftest import column, rows
from loomtable.operators.business import (average_period_change, contribution_attribution, turning_points)
from loomtable.operators.forecast import historical_alerts, project_monthly, scenario_simulation, short_term_forecast
from loomtable.operators.models import (cluster_kmeans, drop_incomplete_rows, encode_binary_target, fit_clusters,
                                        linear_regression, logistic_regression)
from loomtable.operators.profile import stat_key_points, stat_summary, summarize_table
from loomtable.operators.quality import analyze_table, business_observations, decision_assistant, table_health
from loomtable.operators.statistics import (correlation_analysis, diagnostics_report, distribution_analysis,
                                            outlier_detection, outlier_summary, trend_analysis)


def codes(df):
    return {(r["code"], r["column_name"]) for r in df.collect()}


def test_duplicate_rows_and_keys(frame):
    df = frame("asset_id string, hall string, watts string", ("k9", "A", "5"), ("k9", "A", "5"), ("k9", "B", "6"),
               ("k2", "A", "7"), (" ", "C", "8"))
    found = analyze_table(df, top_k=3)
    assert {("duplicate_rows", None), ("duplicate_candidate_key", "asset_id"), ("blank_candidate_key", "asset_id")} <= codes(found)
    assert table_health(found).first()[0] == "risky"
    advice = decision_assistant(df).collect()
    assert [r.name for r in advice if r.kind == "blocking_risk"] == ["duplicate_rows", "duplicate_candidate_key",
                                                                      "blank_candidate_key"]


def test_distribution_findings(frame):
    df = frame("lane string, faults bigint, wait bigint", *[("slow", 0, i % 4 + 5) for i in range(9)], ("fast", 4, 900))
    assert {("high_category_imbalance", "lane"), ("high_zero_ratio", "faults"),
            ("outlier_suspected", "wait")} <= codes(analyze_table(df))


def test_summaries(frame):
    df = frame("depth bigint, basin string, wet boolean", (3, "sea", True), (5, "sea", True), (11, "N/A", True), (None, "", None),
               (1, "bay", True))
    s = {r["column_name"]: r for r in stat_summary(df, top_k=1).collect()}
    assert (s["depth"]["count"], s["depth"]["q1"], s["depth"]["median"], s["depth"]["q3"]) == (4, 2.5, 4.0, 6.5)
    assert s["basin"]["null_count"] == 2 and s["basin"]["distinct_count"] == 2
    assert [tuple(v) for v in s["basin"]["top_values"]] == [("sea", 2)]
    assert s["wet"]["true_ratio"] == 1.0
    assert [r["point"] for r in stat_key_points(df).collect()] == ["concentrated", "mostly_true"]
    empty = summarize_table(df.limit(0)).collect()
    assert {r["missing_rate"] for r in empty} == {None}


def test_observations(frame):
    df = frame("`order date` string, `order time` string, `paid amount` double", ("2026-03-01", "09:10", 10.0),
               ("2026-03-02", "10:00", 20.0), ("2026-03-09", "11:30:00", -5.0), ("2026-04-01", "10:20", 30.0),
               ("2026/03/15", "15:00", 1000.0))
    got = {r["observation_type"]: r for r in business_observations(df, top_k=30).collect()}
    assert got["date_range"]["label"] == "2026-03-01 - 2026-04-01"
    assert (got["date_concentration"]["label"], got["date_concentration"]["share"]) == ("2026-03", 0.8)
    assert got["time_peak_period"]["label"] == "上午" and got["time_business_hour_pattern"]["share"] == 1.0
    assert {"amount_typical_band", "amount_negative_presence", "amount_skew_hint", "median_center"} <= set(got)
    assert business_observations(df, top_k=2).count() == 2


def test_correlation(frame):
    df = frame("t double, a double, b double, flat double", (1.0, 2.0, 9.0, 1.0), (2.0, 4.0, 7.0, 1.0),
               (3.0, 6.0, 5.0, 1.0), (None, 1.0, 1.0, 1.0))
    out = correlation_analysis(df, "t", ["b", "a"])
    assert [(r[0], round(r[1], 9), r[2]) for r in out.collect()] == [("a", 1.0, 3), ("b", -1.0, 3)]
    with pytest.raises(PySparkException, match="constant"):
        correlation_analysis(df, "t", ["flat"]).collect()


def test_outliers(frame):
    df = frame("customer string, amount double", ("a", 10.0), ("b", 12.0), ("c", 11.0), ("d", 13.0), ("e", 200.0), ("f", None))
    assert column(outlier_detection(df, ["amount"]), "amount__is_outlier", "customer") == [False] * 4 + [True, False]
    s = outlier_summary(df, ["amount"]).first()
    assert s["outlier_count"] == 1 and s["outlier_ratio"] == pytest.approx(1 / 6)
    assert outlier_summary(df, ["amount"], "zscore").first()["outlier_count"] == 0
    with pytest.raises(ValueError, match="not numeric"):
        outlier_detection(df, ["customer"])


def test_histogram_edges(frame):
    out = distribution_analysis(frame("v double", (0.0,), (1.0,), (9.99,), (10.0,), (None,)), "v", 5)
    assert column(out, "count", "bin") == [2, 0, 0, 0, 2]
    assert column(distribution_analysis(frame("v double", (3.0,), (3.0,)), "v", 3), "count", "bin") == [2, 0, 0]


def test_trend(frame):
    df = frame("month string, v double, i int", ("2026-03", 130.0, 1), ("2026-01", 100.0, 2), ("2026-02", 90.0, 3),
               ("2026-01", 50.0, 4))
    r = trend_analysis(df, "month", "v", ["i"]).first()
    assert (r.start_value, r.end_value, r.direction, r.point_count) == (100.0, 130.0, "upward", 4)
    assert r.change_rate == pytest.approx(0.3)
    with pytest.raises(PySparkException, match="fewer than 2"):
        trend_analysis(df.limit(1), "month", "v").collect()


def test_diagnostics_degrade(frame):
    df = frame("a double, b double", *[(float(i), float(i * i)) for i in range(8)])
    out = {r["section"]: r for r in diagnostics_report(
        df, correlation={"target_column": "a", "feature_columns": ["b"]}, trend={"time_column": "x", "value_column": "a"}
    ).collect()}
    assert out["trend"]["status"] == "unavailable" and out["report"]["status"] == "degraded"
    assert out["correlation"]["finding"] == "strongest_positive"
    with pytest.raises(ValueError):
        diagnostics_report(df)


def values(df):
    return {r["name"]: r["value"] for r in df.collect()}


def test_least_squares(frame):
    df = frame("feature_a double, feature_b double, target double", (1.0, 2.0, 18.0), (2.0, 1.0, 17.0), (3.0, 3.0, 25.0),
               (4.0, 0.0, 18.0), (5.0, 4.0, 32.0), (None, 1.0, 1.0))
    v = values(linear_regression(df, ["feature_a", "feature_b"], "target"))
    assert v["feature_a"] == pytest.approx(2) and v["feature_b"] == pytest.approx(3)
    assert v["intercept"] == pytest.approx(10) and v["r2"] == pytest.approx(1) and v["dropped_rows"] == 1
    twin = df.selectExpr("feature_a", "feature_a * 2 AS twin", "target")
    with pytest.raises(ValueError, match="dependent"):
        linear_regression(twin, ["feature_a", "twin"], "target")
    with pytest.raises(ValueError, match="too few"):
        linear_regression(df.limit(2), ["feature_a"], "target")


def test_logistic(frame):
    df = frame("score double, result bigint", *[(s, int(s > 4.5)) for s in (1.0, 2.0, 3.0, 7.0, 8.0, 9.0)])
    v = values(logistic_regression(df, ["score"], "result"))
    assert v["training_accuracy"] >= 0.99 and v["positive_rate"] == 0.5 and v["score"] > 0
    rng = random.Random(4)
    noisy = [(x, "yes" if rng.random() < 1 / (1 + math.exp(-(0.8 * x - 1))) else "no") for x in [rng.gauss(0, 2) for _ in range(400)]]
    v = values(logistic_regression(frame("x double, y string", *noisy), ["x"], "y"))
    w, b = 0.0, 0.0
    for _ in range(4000):  # plain gradient ascent on the same likelihood
        gw = gb = 0.0
        for x, y in noisy:
            e = (y == "yes") - 1 / (1 + math.exp(-(w * x + b)))
            gw, gb = gw + e * x, gb + e
        w, b = w + 0.5 * gw / len(noisy), b + 0.5 * gb / len(noisy)
    assert v["x"] == pytest.approx(w, abs=1e-3) and v["intercept"] == pytest.approx(b, abs=1e-3)


def test_binary_targets(frame):
    assert column(encode_binary_target(frame("y string", ("a",), (" b ",), ("",)), "y"), "target") == [0.0, 1.0, None]
    assert column(encode_binary_target(frame("y boolean", (True,), (False,)), "y", "false"), "target") == [0.0, 1.0]
    for df, label in ((frame("y string", ("a",), ("b",), ("c",)), None), (frame("y int", (0,), (2,)), None),
                      (frame("y int", (1,), (1,)), None), (frame("y string", ("a",), ("b",)), "z")):
        with pytest.raises(ValueError):
            encode_binary_target(df, "y", label)


def test_kmeans(frame):
    data = [(1.0, 1.0), (1.2, 0.9), (0.8, 1.1), (10.0, 10.0), (10.2, 10.1), (9.8, 9.9)]
    df = frame("i int, x double, y double", *[(i, *p) for i, p in enumerate(data)], (6, None, 1.0))
    out = cluster_kmeans(df, ["x", "y"], 2, "i").collect()
    assert [(r.row_count, r.share) for r in out] == [(3, 0.5), (3, 0.5)]
    assert out[0].inertia == pytest.approx(0.2) and out[1].center_x == pytest.approx(10.0)
    assert column(fit_clusters(df, ["x", "y"], 2, "i").assign(df), "cluster_id", "i") == [0, 0, 0, 1, 1, 1]
    for k, message in ((1, "two clusters"), (9, "at least as many")):
        with pytest.raises(ValueError, match=message):
            cluster_kmeans(df, ["x", "y"], k, "i")
    with pytest.raises(ValueError, match="distinct points"):
        cluster_kmeans(frame("i int, x double", (1, 2.0), (2, 2.0)), ["x"], 2, "i")


def test_kmeans_folds_equal_points(frame):
    """Copies weigh as rows: the centres of a table and of the same table with each point many times over differ as the means do."""
    points = [(0.0, 0.0)] * 40 + [(1.0, 0.0)] * 20 + [(9.0, 9.0)] * 5 + [(9.0, 10.0)] * 15 + [(-0.0, 0.0)] * 3
    m = fit_clusters(frame("i int, x double, y double", *[(i, *p) for i, p in enumerate(points)]), ["x", "y"], 2, "i")
    assert m.sizes == [63, 20] and m.row_count_used == 83
    assert [[round(float(v), 9) for v in c] for c in m.centers] == [[round(20 / 63, 9), 0.0], [9.0, 9.75]]


def test_kmeans_against_a_plain_model(frame):
    rng = random.Random(8)
    data = [(rng.gauss(c, 1.5), rng.gauss(-c, 1.5)) for c in (0, 4, 9) for _ in range(30)]
    rng.shuffle(data)
    centers, chosen = [data[0]], {0}
    dist = lambda p, q: sum((a - b) ** 2 for a, b in zip(p, q))
    while len(centers) < 3:
        i = max((i for i in range(len(data)) if i not in chosen), key=lambda i: (min(dist(data[i], c) for c in centers), -i))
        centers.append(data[i])
        chosen.add(i)
    ids = None
    while True:
        new = [min(range(3), key=lambda k: (dist(p, centers[k]), k)) for p in data]
        centers = [tuple(statistics.fmean(p[j] for p, k in zip(data, new) if k == c) for j in (0, 1)) for c in range(3)]
        if new == ids:
            break
        ids = new
    m = fit_clusters(frame("i int, x double, y double", *[(i, *p) for i, p in enumerate(data)]), ["x", "y"], 3, "i")
    assert m.sizes == [ids.count(k) for k in range(3)]
    for got, want in zip(m.centers, centers):
        assert got == pytest.approx(want)


def test_forecast_against_a_plain_model(frame):
    v = [10.0, 12.0, 9.0, 15.0, 40.0, 17.0]
    df = frame("k string, t string, v double", *[("a", f"2026-0{i + 1}", x) for i, x in enumerate(v)], ("b", "2026-01", 1.0))
    d = [b - a for a, b in zip(v, v[1:])]
    drift, sigma, es = statistics.fmean(d), statistics.pstdev(d), v[0]
    for x in v[1:]:
        es = 0.5 * x + 0.5 * es
    want = [((v[-1] + drift * h) + (statistics.fmean(v[-3:]) + drift * h * 0.5) + (es + drift * h)) / 3 for h in (1, 2)]
    out = short_term_forecast(df, "t", "v", 2, 9.0, ["k"]).orderBy("step_index").collect()
    assert [r.forecast for r in out] == pytest.approx(want)
    assert out[1].upper_bound - out[1].forecast == pytest.approx(sigma * 2 ** 0.5 * 2.5)
    alerts = historical_alerts(df, "t", "v", 1.0, ["k"]).orderBy("time").collect()
    z = [abs(b - a - drift) / sigma for a, b in zip(v, v[1:])]
    assert [r.alert_level for r in alerts] == ["high" if x >= 1 else "medium" for x in z if x >= 0.7]


def test_scenarios_and_contributions(frame):
    df = frame("t double, d double", *[(10.0 + 2 * i, 5.0 + i) for i in range(6)])
    out = {r["scenario"]: r for r in scenario_simulation(df, "t", ["d"], {"up": {"d": 0.1}, "none": {"zzz": 1.0}}).collect()}
    assert out["up"]["predicted_target"] == pytest.approx(15.0 * 1.1) and out["none"]["predicted_change_pct"] == 0
    p = frame("p string, dim string, v double", ("a", "x", 10.0), ("b", "x", 30.0), ("a", "y", 20.0), ("b", "y", 5.0),
              ("c", "x", 9.0))
    got = [(r.dimension, r.contribution, r.direction) for r in contribution_attribution(p, "p", "dim", "v", "a", "b", 1).collect()]
    assert got == [("x", 20.0, "positive"), ("y", -15.0, "negative")]


def test_projection_and_turning_points(frame):
    last = frame("period_label string, order_count bigint, revenue double, profit_rate double", ("2026-11", 10, 100.0, 0.09))
    out = project_monthly(last, 3, 0.1, -0.03, 0.02, 0.05).collect()
    assert [(r.period_label, r.order_count, round(r.revenue, 4), round(r.profit_rate, 4)) for r in out] == [
        ("2026-12", 11, 110.0, 0.05), ("2027-01", 12, 121.0, 0.02), ("2027-02", 13, 133.1, 0.02)]
    points = frame("period_label string, revenue double, profit double, profit_rate double", ("1", 100.0, 5.0, 0.05),
                   ("2", 110.0, 4.0, 0.03), ("3", 121.0, 6.0, 0.05), ("4", 130.0, 8.0, 0.06))
    assert turning_points(points).first()[0] == "3"
    assert turning_points(points, metric="profit").first()[0] == "4"
    r = average_period_change(points).first()
    assert r[0] == pytest.approx((0.1 + 0.1 + 9 / 121) / 3) and r[1] == pytest.approx(0.01 / 3)


def test_incomplete_rows(frame):
    assert rows(drop_incomplete_rows(frame("a int, b string", (1, " "), (None, "x"), (2, "y")), ["a", "b"])) == [(2, "y")]
