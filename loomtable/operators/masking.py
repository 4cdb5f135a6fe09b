"""Masks that follow from a cell's own value, so equal values stay equal across tables and joins still hold.

Every mask is drawn from SHA-256 of a secret salt and the value (or a key column's value), so it needs no lookup table,
no state and no exchange, except for words, which come from a vocabulary table that the caller gives.

``permute`` is a keyed permutation of the values of one shape: Feistel rounds shift each character of one half of the text by what
the digest of the other half says, digits among digits, capitals among capitals, small letters among small letters, Han characters among
Han characters and accented Latin letters among these.  Lengths, punctuation and number types stay, and different values never meet.

``mask_table`` needs no column names: words in a header choose the mask, the column's type chooses it where no word does.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from loomtable.functions.checks import need_columns, need_numeric, need_some
from loomtable.operators.windows import number_rows
from loomtable.registry import operator

KINDS = ("token", "word", "shift_date", "scale_number", "permute", "constant")
ROUNDS = 4
#: characters that are permuted together
MOST_CHARS = 1 << 20
# First code and size of the blocks in which characters are permuted.
BLOCKS = ((48, 10), (65, 26), (97, 26), (192, 64), (19968, 20992))
# Words in headers and the mask they stand for; the first that a header holds decides.
HEADER_KINDS = (
    ("shift_date", ("日期", "时间", "出单日", "起保日", "生效日", "终保", "到期", "date", "birthday")),
    ("scale_number", ("保额", "限额", "保费", "收入", "金额", "费用", "佣金", "目标", "预算", "赔款", "指标值", "比例", "占比", "费率", "折扣",
                      "amount", "price", "balance", "acctbal", "salary", "premium", "income", "cost", "rate")),
    ("permute", ("名称", "投保主体", "人员", "经办人", "经理", "负责人", "员工", "电话", "手机", "身份证", "证件号", "信用代码", "编号", "合同号", "单号", "保单号",
                 "name", "phone", "mobile", "address", "email", "code", "number", "key", "id")),
    ("token", ("备注", "说明", "remark", "comment", "note")),
)


def _digest(salt: str, purpose: str, value: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{salt}|{purpose}|"), value.cast("string")), 256)


def _draw(digest: Column, n: int | Column) -> Column:
    """A whole number below n, from 60 bits of the digest."""
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint") % n


@operator("mask_values")
def mask_values(df: DataFrame, rules: list[dict], salt: str, vocabulary: DataFrame | None = None) -> DataFrame:
    """One rule per column; nulls stay null, column order and other columns stay.

    ``token``: ``prefix`` and ``length`` digits of the digest.  ``word``: a word of the vocabulary (one column of distinct words).
    ``shift_date``: days moved by up to ``span``, equal for equal values of ``key``.  ``scale_number``: times a factor
    within ``spread`` of one, equal for equal values of ``key``, rounded to ``digits``.  ``permute``: texts and whole numbers of the same
    length and shape, one to one.  ``constant``: the given ``value``.  Columns with one ``purpose`` share masks.
    """
    need_some(rules, "mask rule")
    need_columns(df, [r["column"] for r in rules] + [r["key"] for r in rules if "key" in r])
    out, words = {}, []
    for r in rules:
        c, kind = F.col(f"`{r['column']}`"), r["kind"]
        purpose = r.get("purpose", r["column"])
        if kind not in KINDS:
            raise ValueError(f"unknown mask {kind!r}")
        if kind in ("shift_date", "scale_number") and "key" not in r:
            raise ValueError(f"{kind} needs a key column")
        if kind == "token":
            out[r["column"]] = F.concat(F.lit(r.get("prefix", "")), F.substring(_digest(salt, purpose, c), 1, r.get("length", 16)))
        elif kind == "word":
            words.append((r["column"], purpose))
        elif kind == "constant":
            out[r["column"]] = F.when(c.isNotNull(), F.lit(r["value"]).cast(df.schema[r["column"]].dataType))
        elif kind == "permute":
            out[r["column"]] = _permuted(c, df.schema[r["column"]].dataType, salt, purpose)
        elif kind == "shift_date":
            span = r.get("span", 30)
            days = _draw(_digest(salt, purpose, F.col(f"`{r['key']}`")), 2 * span + 1) - span
            out[r["column"]] = F.date_add(c.cast("date"), days.cast("int"))
        else:
            need_numeric(df, [r["column"]])
            step = _draw(_digest(salt, purpose, F.col(f"`{r['key']}`")), 2001) - 1000
            out[r["column"]] = F.round(c * (1 + step / 1000 * r.get("spread", 0.2)), r.get("digits", 2))
    masked = df.withColumns(out) if out else df
    return _with_words(masked, words, salt, vocabulary, df.columns) if words else masked


def _with_words(df: DataFrame, words: list[tuple[str, str]], salt: str, vocabulary: DataFrame | None, columns: list[str]) -> DataFrame:
    if vocabulary is None:
        raise ValueError("words need a vocabulary")
    word = F.col(f"`{vocabulary.columns[0]}`")
    table = number_rows(vocabulary.select(word.alias("__word")), [], ["__word"], "__n").withColumn("__n", F.col("__n") - 1)
    size = vocabulary.count()
    if not size:
        raise ValueError("the vocabulary is empty")
    for i, (column, purpose) in enumerate(words):
        picked = table.select(F.col("__word").alias(f"__w{i}"), F.col("__n").alias(f"__n{i}"))
        df = (df.withColumn(f"__d{i}", _draw(_digest(salt, purpose, F.col(f"`{column}`")), size))
              .join(picked, F.col(f"__d{i}") == F.col(f"__n{i}"), "left").withColumn(column, F.col(f"__w{i}")))
    return df.select(*[f"`{c}`" for c in columns])


def _moved(halves: list[str], others: list[str], salted: bytes, leading: bool) -> list[str]:
    """The halves with each character moved inside its block, by two bytes of the other half's digest each."""
    length = np.array([len(h) for h in halves])
    end = np.cumsum(length)
    row = np.repeat(np.arange(len(halves)), length)
    place = np.arange(len(row)) - np.repeat(end - length, length)
    code = np.frombuffer("".join(halves).encode("utf-32-le"), np.uint32).astype(np.int64)
    digest = np.frombuffer(b"".join([hashlib.sha256(salted + o.encode()).digest() for o in others]), np.uint8).reshape(-1, 32)
    by = digest[row, place % 30].astype(np.int64) * 256 + digest[row, place % 30 + 1]
    out = code.copy()
    for start, size in BLOCKS:
        inside = (code >= start) & (code < start + size)
        out[inside] = (code[inside] - start + by[inside]) % size + start
    if leading:
        first = place == 0
        digit = first & (code >= 49) & (code <= 57)
        out[first] = code[first]
        out[digit] = (code[digit] - 49 + by[digit]) % 9 + 49
    text = out.astype(np.uint32).tobytes().decode("utf-32-le")
    return [text[e - n:e] for e, n in zip(end.tolist(), length.tolist())]


def _permuted(value: Column, kind: T.DataType, salt: str, purpose: str) -> Column:
    if isinstance(kind, T.StringType):
        return _feistel(value, salt, purpose, False)
    most = {T.ByteType: 127, T.ShortType: 32767, T.IntegerType: 2147483647, T.LongType: 9223372036854775807}.get(type(kind))
    if most is None:
        raise ValueError(f"permute needs texts or whole numbers, not {kind.simpleString()}")
    # numbers as long as the type's largest keep their first two digits; those that start like the largest keep all
    text = F.regexp_replace(value.cast("string"), "^-", "")
    long, near = F.length(text) == len(str(most)), F.substring(text, 1, 2) >= str(most)[:2]
    # a Python column is made for every row: each of the two gets only the texts that it serves
    short, rest = F.when(~long, text), F.when(long & ~near, F.substring(text, 3, 20))
    digits = (F.when(~long, _feistel(short, salt, purpose, True)).when(near, text)
              .otherwise(F.concat(F.substring(text, 1, 2), _feistel(rest, salt, purpose, False))))
    return F.concat(F.when(value < 0, "-").otherwise(""), digits).cast(kind)


def _feistel(text: Column, salt: str, purpose: str, leading: bool) -> Column:
    """Rounds over the two halves of a text; with ``leading`` the first character is a digit that does not become 0.

    The different texts of an Arrow batch are permuted together, ``MOST_CHARS`` characters or one text at a time.
    """
    def rounds(texts: list[str]) -> list[str]:
        a, b = [t[:-(-len(t) // 2)] for t in texts], [t[-(-len(t) // 2):] for t in texts]
        for turn in range(1, ROUNDS + 1):
            salted = f"{salt}|{purpose}|{turn}|".encode()
            if turn % 2:
                a = _moved(a, b, salted, leading)
            else:
                b = _moved(b, a, salted, False)
        return [x + y for x, y in zip(a, b)]

    def permuted(column: pa.Array) -> pa.Array:
        coded = column.dictionary_encode()
        texts, done, start = coded.dictionary.to_pylist(), [], 0
        while start < len(texts):
            stop, chars = start + 1, len(texts[start])
            while stop < len(texts) and chars + len(texts[stop]) <= MOST_CHARS:
                chars += len(texts[stop])
                stop += 1
            done += rounds(texts[start:stop])
            start = stop
        return pa.array(done, pa.string()).take(coded.indices)

    return F.arrow_udf(permuted, "string")(text)


@operator("mask_rules")
def mask_rules(df: DataFrame, keep: list[str] | None = None, purposes: dict[str, str] | None = None) -> list[dict]:
    """A rule for every column not kept: by words in its header where its type allows that mask, else by its type."""
    rules = []
    for f in df.schema.fields:
        if f.name in (keep or []):
            continue
        header, whole = f.name.strip().lower(), isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
        number, text = isinstance(f.dataType, T.NumericType), isinstance(f.dataType, T.StringType)
        day = isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))
        able = {"shift_date": day, "scale_number": number, "permute": text or whole, "token": text}
        kind = next((k for k, some in HEADER_KINDS if able[k] and any(w in header for w in some)), None)
        if kind is None:
            kind = "permute" if text or whole else "scale_number" if number else "shift_date" if day else "constant"
        rule = {"column": f.name, "kind": kind, "purpose": (purposes or {}).get(f.name, f.name)}
        if kind in ("shift_date", "scale_number"):
            rule["key"] = f.name
        if kind == "constant":
            rule["value"] = True if isinstance(f.dataType, T.BooleanType) else None
        rules.append(rule)
    return rules


@operator("mask_table")
def mask_table(df: DataFrame, salt: str, keep: list[str] | None = None, purposes: dict[str, str] | None = None) -> DataFrame:
    """The whole table masked without naming its columns; every column keeps its type.

    Columns of other tables that are joined on get one purpose here and there.  Flags become true, nested columns null.
    """
    rules = mask_rules(df, keep, purposes)
    if not rules:
        return df
    masked = mask_values(df, rules, salt)
    return masked.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in df.schema.fields])
