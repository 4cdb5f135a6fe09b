import math
import random

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from conftest import column, rows
from loomtable.functions.quantiles import quantile_rows, value_bin
from loomtable.operators.grouping import group_and_aggregate, pivot_cells, pivot_table
from loomtable.operators.ordering import append_tables, deduplicate_by_key, distinct_rows, sort_rows, top_n
from loomtable.operators.windows import forward_fill, number_rows, window_calculation

CALCS = [{"kind": "row_number", "output_column": "n"}, {"kind": "rank", "output_column": "rk"},
         {"kind": "percent_rank", "output_column": "pr"},
         {"kind": "cumulative_sum", "source_column": "v", "output_column": "cs"},
         {"kind": "lag", "source_column": "v", "offset": 2, "output_column": "lg"},
         {"kind": "lead", "source_column": "v", "offset": 3, "output_column": "ld"},
         {"kind": "rolling_sum", "source_column": "v", "window_size": 4, "output_column": "rs"},
         {"kind": "rolling_mean", "source_column": "v", "window_size": 3, "output_column": "rm"}]


def model(data):
    """Plain Python windows over rows (g, o, id, v)."""
    out = {}
    for g in {r[0] for r in data}:
        part = sorted((r for r in data if r[0] == g), key=lambda r: (r[1], r[2]))
        v = [r[3] or 0 for r in part]
        order = [r[1] for r in part]
        for i, r in enumerate(part):
            before = sum(o < r[1] for o in order)
            win4, win3 = v[max(0, i - 3): i + 1], v[max(0, i - 2): i + 1]
            out[r[2]] = (i + 1, len(set(o for o in order if o <= r[1])),
                         before / (len(part) - 1) if len(part) > 1 else 0.0, float(sum(v[: i + 1])),
                         part[i - 2][3] if i >= 2 else None, part[i + 3][3] if i + 3 < len(part) else None,
                         float(sum(win4)), sum(win3) / len(win3))
    return out


def check(spark, data, hot):
    df = spark.createDataFrame(data, "g string, o int, id int, v int")
    out = window_calculation(df, ["g"], [{"column": "o"}], CALCS, ["id"], hot)
    want = model(data)
    got = {r["id"]: r for r in out.collect()}
    assert len(got) == len(data)
    for i, w in want.items():
        r = got[i]
        assert (r.n, r.rk, r.cs, r.lg, r.ld, r.rs) == (w[0], w[1], w[3], w[4], w[5], w[6])
        assert r.pr == pytest.approx(w[2]) and r.rm == pytest.approx(w[7])


@pytest.mark.parametrize("hot", [None, 4, 25])
def test_windows_against_a_plain_model(spark, hot):
    rng = random.Random(5)
    data = [(rng.choice("aaaab"), rng.randrange(12), i, rng.choice([None, *range(9)])) for i in range(120)]
    check(spark, data, hot)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 5), st.one_of(st.none(), st.integers(-9, 9))),
                min_size=1, max_size=40), st.sampled_from([2, 5, 1000]))
def test_windows_on_random_frames(spark, data, hot):
    check(spark, [(g, o, i, v) for i, (g, o, v) in enumerate(data)], hot)


def test_ranks_skip_no_value_and_ignore_row_ids(frame):
    df = frame("team string, pts int, no int", ("x", 3, 9), ("x", 3, 8), ("x", 1, 7), ("x", 9, 6), (None, 2, 5))
    out = window_calculation(df, ["team"], [{"column": "pts", "descending": True}],
                             [{"kind": "row_number", "output_column": "n"}, {"kind": "rank", "output_column": "d"},
                              {"kind": "percent_rank", "output_column": "p"}], ["no"])
    assert rows(out.select("no", "n", "d", "p"), "no") == [
        (5, 1, 1, 0.0), (6, 1, 1, 0.0), (7, 4, 3, 1.0), (8, 2, 2, 1 / 3), (9, 3, 2, 1 / 3)]


def test_ties_without_a_row_id_follow_the_other_columns(frame):
    df = frame("g string, o int, a int, b int", ("g", 1, 5, 2), ("g", 1, 5, 1), ("g", 1, 4, 9))
    out = window_calculation(df, ["g"], ["o"], [{"kind": "row_number", "output_column": "n"},
                                                {"kind": "lag", "source_column": "b", "output_column": "p"}])
    assert rows(out.select("a", "b", "n", "p"), "n") == [(4, 9, 1, None), (5, 1, 2, 9), (5, 2, 3, 1)]


def test_window_checks(frame):
    df = frame("a int, t string", (1, "x"))
    for calc, message in (({"kind": "lag", "output_column": "z"}, "source column"),
                          ({"kind": "rolling_sum", "source_column": "t", "window_size": 2, "output_column": "z"}, "not numeric"),
                          ({"kind": "rolling_sum", "source_column": "a", "output_column": "z"}, "window size"),
                          ({"kind": "lag", "source_column": "a", "offset": 0, "output_column": "z"}, "offset"),
                          ({"kind": "row_number", "output_column": "a"}, "twice"), ({"kind": "ntile", "output_column": "z"}, "unknown")):
        with pytest.raises(ValueError, match=message):
            window_calculation(df, [], ["a"], [calc])
    with pytest.raises(ValueError, match="order column"):
        window_calculation(df, [], [], [{"kind": "row_number", "output_column": "z"}])


@pytest.mark.parametrize("hot", [None, 7])
def test_forward_fill_and_numbers(spark, hot):
    rng = random.Random(3)
    data = [(i, rng.choice([None, "", "a", "b", " "])) for i in range(60)]
    df = spark.createDataFrame(data, "i int, v string")
    last, want = None, []
    for _, v in data:
        last = v if v and v.strip() else last
        want.append(last if last is not None else v)
    assert column(forward_fill(df, ["v"], [], ["i"], hot), "v", "i") == want
    assert column(number_rows(df, [], [{"column": "i", "descending": True}], "n", hot), "n", "i") == list(range(60, 0, -1))


def test_exact_quantiles(spark):
    rng = random.Random(9)
    data = [(rng.choice([None, rng.gauss(0, 50), 7.0]), float(i % 3)) for i in range(501)]
    df = spark.createDataFrame(data, "a double, b double")
    got = {r[0]: r[1] for r in quantile_rows(df, ["a", "b"], [0.0, 0.25, 0.5, 0.9, 1.0]).collect()}
    for i, name in enumerate("ab"):
        v = sorted(r[i] for r in data if r[i] is not None)
        for q, value in zip([0.0, 0.25, 0.5, 0.9, 1.0], got[name]):
            p = q * (len(v) - 1)
            low = int(p)
            high = min(low + 1, len(v) - 1)
            assert value == pytest.approx(v[low] + (v[high] - v[low]) * (p - low))


def test_quantiles_of_odd_numbers(spark):
    """Signs, zeros, the smallest and largest doubles, infinities, NaN last, ties, an empty column; against a sorted list."""
    rng = random.Random(4)
    tiny, huge, inf = 5e-324, 1.7976931348623157e308, float("inf")
    odd = [0.0, -0.0, tiny, -tiny, 2 ** -1022, 1.0, 2.0, 2.0 - 2 ** -52, 2.0 + 2 ** -51, huge, -huge, inf, -inf, float("nan")]
    columns = {"odd": odd, "near": [1 + rng.randrange(400) * 2 ** -52 for _ in odd * 30], "none": [], "one": [3.5],
               "wide": [math.copysign(2.0 ** rng.uniform(-1070, 1020), rng.choice([1, -1])) for _ in odd * 30]}
    height = max(map(len, columns.values()))
    data = [tuple(v[i] if i < len(v) else None for v in columns.values()) for i in range(height)]
    df = spark.createDataFrame(data, ", ".join(f"{c} double" for c in columns)).repartition(5)
    got = {r[0]: r[1] for r in quantile_rows(df, list(columns), [0.0, 0.5, 1.0]).collect()}
    for name, v in columns.items():
        v = sorted(v, key=lambda x: (math.isnan(x), x))
        if not v:
            assert got[name] == [None] * 3
            continue
        middle = (len(v) - 1) / 2
        low, high = v[math.floor(middle)], v[math.ceil(middle)]
        want = [v[0], low if low == high else low + (high - low) * (middle - math.floor(middle)), v[-1]]
        assert [repr(x) for x in got[name]] == [repr(x) for x in want], name
    ordered = [r[0] for r in df.select("wide").filter("wide is not null").orderBy(value_bin(F.col("wide")), "wide").collect()]
    assert ordered == sorted(columns["wide"])


def test_group_and_pivot(frame):
    df = frame("region string, month string, sales bigint", ("East", "Jan", 150), ("East", "Feb", 50), ("West", "Jan", 150),
               (None, "Jan", None))
    out = group_and_aggregate(df, ["region"], [{"column": "sales", "operator": "sum"}, {"column": "sales", "operator": "count"}])
    assert rows(out) == [(None, None, 1), ("East", 200, 2), ("West", 150, 1)]
    p = pivot_table(df, ["region"], ["month"], ["sales"], "sum")
    assert p.columns == ["region", "Feb", "Jan"]
    assert rows(p) == [("", None, None), ("East", 50.0, 150.0), ("West", None, 150.0)]
    assert rows(pivot_table(df, ["region"], ["month"], ["sales"], "count")) == [("", None, 0), ("East", 1, 1), ("West", None, 1)]
    with pytest.raises(ValueError, match="not numeric"):
        group_and_aggregate(df, ["region"], [{"column": "month", "operator": "sum"}])
    with pytest.raises(ValueError, match="one value"):
        pivot_table(df, ["region"], ["month"], ["sales", "region"], "count")


def test_ordering(frame):
    df = frame("k string, v int, i int", ("a", 2, 1), ("a", None, 2), ("b", 1, 3), (None, 5, 4), ("", 5, 5))
    assert column(sort_rows(df, [{"column": "v", "descending": True}, {"column": "i"}]), "i") == [2, 4, 5, 1, 3]
    assert column(sort_rows(df, [{"column": "v"}, {"column": "i"}]), "i") == [2, 3, 1, 4, 5]
    assert column(top_n(df, [{"column": "i", "descending": True}], 2), "i") == [5, 4]
    assert column(distinct_rows(df, ["k"], "first", ["i"]), "i", "i") == [1, 3, 4, 5]
    assert column(distinct_rows(df, ["k"], "last", ["i"]), "i", "i") == [2, 3, 4, 5]
    versions = frame("id string, at string, score string", ("1", "2026-01-01", "9"), ("1", "2026-02-01", "10"), ("2", None, "1"))
    latest = deduplicate_by_key(versions, ["id"], [{"column": "at", "direction": "desc"}], "first", ["score"])
    assert rows(latest, "id") == [("1", "2026-02-01", "10"), ("2", None, "1")]
    by_text = deduplicate_by_key(versions, ["id"], [{"column": "score"}], "last")
    assert rows(by_text.select("id", "score"), "id") == [("1", "9"), ("2", "1")]
    with pytest.raises(ValueError, match="same columns"):
        append_tables(df, versions)


def test_long_pivot_has_the_cells_of_the_wide_one(frame):
    df = frame("r string, c string, v int", ("a", "x", 1), ("a", "y", 2), ("b", "x", 3), ("a", "x", 4), (None, "z", 5))
    wide = pivot_table(df, ["r"], ["c"], ["v"], "sum").collect()
    long = {(r.r, r.header): r.value for r in pivot_cells(df, ["r"], ["c"], ["v"], "sum").collect()}
    assert long == {(w["r"], h): w[h] for w in wide for h in "xyz" if w[h] is not None}


def test_a_pivot_refuses_more_headers_than_its_bound(frame):
    df = frame("r string, c int, v int", ("x", 1, 1), ("x", 2, 2), ("y", 3, 3))
    assert len(pivot_table(df, ["r"], ["c"], ["v"], "sum", max_headers=3).columns) == 4
    with pytest.raises(ValueError, match="more than 2 headers"):
        pivot_table(df, ["r"], ["c"], ["v"], "sum", max_headers=2)


def test_a_fill_crosses_chunks_and_groups(frame, spark):
    values = [(g, i, f"{g}{i}" if (i * 7 + len(g)) % 11 == 0 else [None, "", " "][i % 3]) for g in ("a", "bb") for i in range(400)]
    df = frame("g string, i int, v string", *values, (None, 1, "n"), (None, 2, None)).repartition(6)
    for keys in ([], ["g"]):
        order = ["g", "i"] if not keys else ["i"]
        got = {(r.g, r.i): r.v for r in forward_fill(df, ["v"], keys, order, block_rows=50).collect()}
        last, group = None, object()
        for g, i, v in sorted([*values, (None, 1, "n"), (None, 2, None)], key=lambda x: (x[0] is not None, x[0] or "", x[1])):
            if keys and g != group:
                last, group = None, g
            last = v if v and v.strip() else last
            assert got[g, i] == (last if last is not None else v), (keys, g, i)
