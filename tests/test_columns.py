import pytest
from pyspark.errors import PySparkException

from conftest import column, rows
from loomtable.functions.values import (looks_like_amount_name, looks_like_date_name, looks_like_identifier_name,
                                        looks_like_time_name, resolve_column)
from loomtable.operators.cleaning import fill_missing_values, normalize_text_columns, parse_datetime_columns
from loomtable.operators.columns import (cast_column_types, display_numbers, format_table_for_export, preview_table,
                                         rename_columns, select_columns)
from loomtable.operators.derive import derive_columns
from loomtable.operators.filters import count_matching_lines, filter_rows, flag_rows


def test_select_and_rename_checks(frame):
    df = frame("a int, b int", (1, 2))
    assert select_columns(df, ["b", "a"]).columns == ["b", "a"]
    with pytest.raises(ValueError, match="no column"):
        select_columns(df, ["c"])
    with pytest.raises(ValueError, match="twice"):
        rename_columns(df, [{"from": "a", "to": "b"}])
    with pytest.raises(ValueError, match="twice"):
        rename_columns(df, [{"from": "a", "to": "x"}, {"from": "a", "to": "y"}])


def test_cast_is_strict(frame):
    df = frame("v string", ("12",), ("x",))
    good = cast_column_types(df.filter("v = '12'"), [{"column": "v", "target_type": "int64"}])
    assert rows(good) == [(12,)]
    with pytest.raises(PySparkException):
        cast_column_types(df, [{"column": "v", "target_type": "int64"}]).collect()


def test_normalize_text(frame):
    df = frame("sku string, place string", ("\tKx/7   Q ", "north\tdock"), ("zz//", "Dock  dock"), (None, ""))
    out = normalize_text_columns(df, [
        {"column": "sku", "trim": True, "collapse_whitespace": True, "lowercase": True, "remove_chars": ["/"]},
        {"column": "place", "collapse_whitespace": True, "uppercase": True, "replace_pairs": [{"from": "DOCK", "to": "PIER"}]}])
    assert rows(out) == [("kx7 q", "NORTH PIER"), ("zz", "PIER PIER"), (None, "")]
    with pytest.raises(ValueError, match="twice"):
        normalize_text_columns(df, [{"column": "sku"}, {"column": "sku"}])


def test_fill_missing(frame):
    df = frame("n int, shelf string, stock string, note string",
               (1, "", "7", "\t"), (2, "B4", None, "late"), (3, None, " ", ""), (4, "C1", "", None), (5, "\n", "3", "ok"))
    out = fill_missing_values(df, [{"column": "shelf", "strategy": "constant", "value": "floor"},
                                   {"column": "stock", "strategy": "zero"},
                                   {"column": "note", "strategy": "forward_fill"}], ["n"])
    assert rows(out, "n") == [(1, "floor", "7", "\t"), (2, "B4", "0", "late"), (3, "floor", "0", "late"),
                              (4, "C1", "0", "late"), (5, "floor", "3", "ok")]
    with pytest.raises(ValueError, match="needs a value"):
        fill_missing_values(df, [{"column": "shelf", "strategy": "constant"}])


def test_parse_dates(frame):
    df = frame("a string, b string", ("2026/03/01", "2026-03-01 8:30"), ("2026-03-02", "2026-03-02T09:15:20"),
               (" ", "2026/3/2"), (None, "61.5"), ("61", "61"))
    out = parse_datetime_columns(df, [{"column": "a", "target_type": "date"}, {"column": "b", "target_type": "datetime"}])
    assert rows(out) == [("2026-03-01", "2026-03-01 08:30:00"), ("2026-03-02", "2026-03-02 09:15:20"),
                         (" ", "2026-03-02 00:00:00"), (None, "1900-03-01 12:00:00"), ("1900-03-01", "1900-03-01 00:00:00")]


@pytest.mark.parametrize("kind,bad", [("date", "2026-02-30"), ("date", "soon"), ("datetime", "2026-01-01 25:00"),
                                      ("datetime", "2026-01-01 noon"), ("date", "-3")])
def test_bad_dates_fail(frame, kind, bad):
    with pytest.raises(PySparkException):
        parse_datetime_columns(frame("a string", (bad,)), [{"column": "a", "target_type": kind}]).collect()


def test_serial_numbers(frame):
    df = frame("d bigint, t double", (45292, 45292.25), (400, 366.75))
    out = parse_datetime_columns(df, [{"column": "d", "target_type": "date"}, {"column": "t", "target_type": "datetime"}])
    assert rows(out)[0] == ("2024-01-01", "2024-01-01 06:00:00")
    assert rows(out)[1] == ("1901-02-03", "1900-12-31 18:00:00")


def test_derive(frame):
    df = frame("tank string, level bigint, leaks bigint, seen string", ("t1", 7, 0, "2023-02-28"), ("t2", 55, 2, "2023-03-01"),
               ("t3", 80, 9, "2025-12-31"))
    c = lambda col, op, v: {"column": col, "operator": op, "value": v}
    out = derive_columns(df, [
        {"kind": "case_when", "output_column": "state", "else_value": "fine", "rules": [
            {"when": {"mode": "all", "conditions": [c("level", "gte", "50"), c("leaks", "gt", "5")]}, "value": "drain"},
            {"when": {"mode": "any", "conditions": [c("level", "lt", "10"), c("leaks", "gt", "1")]}, "value": "look"}]},
        {"kind": "date_bucketize", "source_column": "seen", "output_column": "when", "else_value": "later",
         "buckets": [{"label": "winter", "start_inclusive": "2023-01-01", "end_exclusive": "2023-03-01"},
                     {"label": "spring", "start_inclusive": "2023-03-01", "end_exclusive": "2023-06-01"}]},
        {"kind": "template", "output_column": "card", "template": "{state}/{when}/{tank}"},
        {"kind": "template", "output_column": "tank", "template": "<{tank}> {open"},
        {"kind": "score_rules", "output_column": "points", "default_score": -3,
         "rules": [{"when": c("leaks", "gte", "2"), "score": 10}, {"when": c("level", "lt", "60"), "score": 4}]}])
    assert rows(out.select("state", "when", "card", "tank", "points")) == [
        ("look", "winter", "look/winter/t1", "<t1> {open", 1), ("look", "spring", "look/spring/t2", "<t2> {open", 11),
        ("drain", "later", "drain/later/t3", "<t3> {open", 7)]
    with pytest.raises(ValueError, match="no column"):
        derive_columns(df, [{"kind": "template", "output_column": "x", "template": "{nope}"}])


def test_unreadable_numbers_are_false_and_fall_to_else(frame):
    df = frame("v string", ("10",), ("x",), (None,), ("1e1",))
    out = derive_columns(df, [{"kind": "bucketize", "source_column": "v", "output_column": "b", "else_value": "?",
                               "buckets": [{"label": "ten", "min_inclusive": 10, "max_exclusive": 11}]}])
    assert column(out, "b") == ["ten", "?", "?", "ten"]
    assert filter_rows(df, [{"column": "v", "operator": "gte", "value": "1"}]).count() == 2


@pytest.mark.parametrize("text,day", [("2026-01-15", True), ("2026/1/5", True), ("2026-01-15 08:30", True),
                                      ("2026-01-15T08:30:00", True), ("2026-01-15T08:30", False),
                                      ("2026/01/15 08:30", False), ("15.01.2026", False)])
def test_date_bucket_formats(frame, text, day):
    out = derive_columns(frame("d string", (text,)), [
        {"kind": "date_bucketize", "source_column": "d", "output_column": "b", "else_value": "no",
         "buckets": [{"label": "yes"}]}])
    assert column(out, "b") == ["yes" if day else "no"]


def test_flags_and_lines(frame):
    df = frame("k string, g string, v double", ("a", "x", -1.0), ("a", "y", 5.0), ("b", "y", 50.0), (" ", "y", None))
    out = flag_rows(df, [{"kind": "negative", "column": "v", "output_column": "neg"},
                         {"kind": "duplicate", "column": "k", "output_column": "dup"},
                         {"kind": "composite_duplicate", "columns": ["k", "g"], "output_column": "pair"},
                         {"kind": "between", "column": "v", "min": 5, "max": 50, "output_column": "mid"},
                         {"kind": "null", "column": "k", "output_column": "gap"}])
    got = {(r["k"], r["g"]): (r["neg"], r["dup"], r["pair"], r["mid"], r["gap"]) for r in out.collect()}
    assert got[("a", "x")] == (True, True, False, False, False)
    assert got[("b", "y")] == (False, False, False, True, False)
    assert got[(" ", "y")] == (False, False, False, False, True)
    texts = frame("id int, t string", (1, "java -jar app\nsshd\n\njava x"), (2, "init"))
    assert rows(count_matching_lines(texts, "t", ["java"], ["id"]), "id") == [(1, 2), (2, 0)]


def test_layout_and_display(frame):
    df = frame("a int, b double, c string", (1, 2.5, None))
    assert format_table_for_export(df, ["c", "a"], [{"from": "a", "to": "A"}]).columns == ["c", "A", "b"]
    assert format_table_for_export(df, ["c"], drop_unspecified_columns=True).columns == ["c"]
    assert rows(preview_table(df)) == [("1", "2.5", "")]
    shown = display_numbers(frame("a double, b double, c double", (1234.5, 0.256, None)),
                            {"a": "currency", "b": "percent", "c": "integer"})
    assert rows(shown) == [("¥1,234.50", "25.60%", None)]


def test_column_names():
    assert looks_like_identifier_name("user_id") and looks_like_identifier_name("客户编号")
    assert not looks_like_identifier_name("notes")
    assert looks_like_date_name("Order Date") and looks_like_time_name("order time")
    assert looks_like_amount_name("paid amount")
    assert resolve_column(["Svc", "CPU-Usage", "mem"], ["cpu_usage", "cpu"]) == "CPU-Usage"
    assert resolve_column(["my_cpu_pct"], ["cpu_usage", "cpu"]) == "my_cpu_pct"
    assert resolve_column(["x"], ["cpu"], "X") == "x"
    assert resolve_column(["x"], ["cpu"]) is None
