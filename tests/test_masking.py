"""Masks that keep types and never meet."""

import datetime as dt
import re
from decimal import Decimal

import pytest

from conftest import column
from loomtable.operators.masking import mask_rules, mask_table, mask_values


def permuted(df, name, salt="s", purpose="p"):
    return mask_values(df, [{"column": name, "kind": "permute", "purpose": purpose}], salt)


def test_permutation_is_one_to_one_and_keeps_length(spark):
    df = spark.range(0, 2000).selectExpr("id as old", "id as n", "cast(id as string) as t", "cast(-id as int) as m")
    out = permuted(permuted(permuted(df, "n"), "t"), "m").collect()
    for name in ("n", "m"):
        assert len({r[name] for r in out}) == 2000
        assert all(len(str(abs(r[name]))) == len(str(r.old)) for r in out)
        assert {abs(r[name]) for r in out if 100 <= r.old < 1000} == set(range(100, 1000))
    assert {r.t for r in out if 10 <= r.old < 100} <= {f"{i:02d}" for i in range(100)}
    assert len({r.t for r in out}) == 2000 and all(r.m <= 0 for r in out)
    assert sum(r.n == r.old for r in out) < 60


def test_permutation_keeps_the_shape_of_texts(frame):
    texts = ["Ab-12 x", "Ab-12 y", "AB-12 x", "", "é9", "张三", "李四", "a", "13800138000", "😀?", None]
    df = frame("t string", *[(t,) for t in texts])
    got = column(permuted(df, "t"), "t")
    shape = lambda t: re.sub(r"[一-鿿]", "汉", re.sub(r"[À-ÿ]", "à", re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", re.sub(r"\d", "0", t or "-")))))
    assert sorted(map(shape, got)) == sorted(map(shape, texts)) and len(set(got)) == len(texts)
    assert "张三" not in got and "13800138000" not in got and None in got
    assert got != column(permuted(df, "t", salt="other"), "t") and got != column(permuted(df, "t", purpose="q"), "t")
    assert got == column(permuted(df, "t"), "t")


def test_numbers_at_the_end_of_their_type_stay_in_it(frame):
    values = [2147483647, 2099999999, 1000000000, -2147483648, 0, 7, -7]
    df = frame("i int, b bigint, s smallint", *[(v, v * 4294967296 if abs(v) > 9 else v, max(-32768, min(32767, v))) for v in values])
    out = permuted(permuted(permuted(df, "i"), "b"), "s").collect()
    assert len({r.i for r in out}) == len({r.b for r in out}) == len(values)
    assert out[0].i == 2147483647 and str(out[1].i).startswith("20") and out[4].i == 0
    assert all((r.i < 0) == (v < 0) for r, v in zip(out, values))


def test_a_table_is_masked_without_naming_its_columns(spark, frame):
    schema = ("`客户名称` string, customer_id bigint, `保费金额` double, price decimal(10,2), order_date date, changed timestamp, active boolean, "
              "`说明` string, other string, share float, nested struct<a:int>")
    row = ("张三", 12345, 100.0, Decimal(5), dt.date(2024, 1, 31), dt.datetime(2024, 1, 1, 5), False, "free text", "Z-1", 0.5, (1,))
    df = frame(schema, row, tuple([None] * 11), row)
    kinds = {r["column"]: r["kind"] for r in mask_rules(df)}
    assert kinds == {"客户名称": "permute", "customer_id": "permute", "保费金额": "scale_number", "price": "scale_number", "order_date": "shift_date",
                     "changed": "shift_date", "active": "constant", "说明": "token", "other": "permute", "share": "scale_number", "nested": "constant"}
    out = mask_table(df, "s", keep=["share"])
    assert out.schema.simpleString() == df.schema.simpleString()
    first, nulls, again = out.collect()
    assert first == again and all(v is None for v in nulls)
    assert first["客户名称"] != "张三" and 10000 <= first.customer_id <= 99999 and first.customer_id != 12345
    assert 80 <= first["保费金额"] <= 120 and abs((first.order_date - row[4]).days) <= 30 and first.active is True and first.share == 0.5
    assert first.nested is None and mask_table(df.select("share"), "s", keep=["share"]).collect() == df.select("share").collect()
    shared = mask_table(frame("cust bigint", (12345,)), "s", purposes={"cust": "customer_id"}).first()[0]
    assert shared == first.customer_id


def test_what_cannot_be_permuted(frame):
    with pytest.raises(ValueError, match="permute needs"):
        permuted(frame("x double", (1.0,)), "x")


def test_texts_are_permuted_in_batches_not_character_by_character_in_the_plan(spark, frame):
    df = frame("t string, n bigint", ("Customer#000000001", 1234), ("", 0), (None, None), ("Customer#000000001", -1234), ("x" * 3_000_000, 9))
    out = mask_table(df, "pepper")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "lambdafunction" not in plan and "ArrowEvalPython" in plan
    one, empty, nulls, again, long = out.collect()
    assert one.t == again.t and one.n == -again.n and empty.t == "" and tuple(nulls) == (None, None) and len(long.t) == 3_000_000
