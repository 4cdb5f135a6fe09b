"""Conversations as training text with an offset-aligned loss mask.

A whole conversation is rendered once, encoded once with offsets, and the sorted spans of its assistant texts are
intersected with the token spans by binary search, so the mask is right wherever a token straddles a turn's edge.
Control strings inside texts are escaped reversibly: a backslash is doubled and a control string gets a backslash after its first
character, so no text can open or close a turn.

Defined results: rows of one conversation are ordered by turn, then role, then text (null first); a null text is empty and a
null role is the empty role; rows with a null conversation id form one conversation; repeated rows are turns of their own; an empty
table gives an empty result.  A conversation is one row, as large as its text.  Extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
MARKS = {"system": ("<<SYS>> ", " <</SYS>>\n"), "user": ("[INST] ", " [/INST]"), "assistant": (" <s> ", " </s>\n")}
CONTROL = r"(\[(?=/?INST\]|/?ROLE[ \]])|<(?=/?s>|</?SYS>>))"
_CONTROL, _TURN = re.compile(CONTROL), re.compile(r"\[INST\] | <s> |<<SYS>> |\[ROLE ([^ \]]*)\] ")
_ENDS = {"[INST] ": ("user", " [/INST]"), " <s> ": ("assistant", " </s>\n"), "<<SYS>> ": ("system", " <</SYS>>\n")}


def escaped(text: str) -> str:
    return _CONTROL.sub(r"\1\\", text.replace("\\", "\\\\"))


def unescaped(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def marks(role: str) -> tuple[str, str]:
    return MARKS.get(role) or (f"[ROLE {quote(role, safe='')}] ", " [/ROLE]")


def rendered(turns: list[tuple[str, str]]) -> tuple[str, np.ndarray]:
    """The text, and (start, end) of each assistant text in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        before, after = marks(role)
        body = escaped(text)
        parts += [before, body, after]
        if role == "assistant":
            spans.append((at + len(before), at + len(before) + len(body)))
        at += len(before) + len(body) + len(after)
    return "".join(parts), np.array(spans, np.int64).reshape(-1, 2)


def parsed(text: str) -> list[tuple[str, str]]:
    """The turns of a rendered conversation."""
    turns, at = [], 0
    while at < len(text):
        m = _TURN.match(text, at)
        role, after = _ENDS.get(m[0]) or (unquote(m[1]), " [/ROLE]")
        end = text.index(after, m.end())
        turns.append((role, unescaped(text[m.end():end])))
        at = end + len(after)
    return turns


def masked(tokens: np.ndarray, spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which tokens (start, end) touch a span, and the index of the first span that ends after each token's start."""
    first = np.searchsorted(spans[:, 1], tokens[:, 0], side="right")
    inside = first < len(spans)
    touched = np.zeros(len(tokens), bool)
    touched[inside] = (spans[first[inside], 0] < tokens[inside, 1]) & (tokens[inside, 0] < tokens[inside, 1])
    return touched, first


def loss_spans(tokens: np.ndarray, touched: np.ndarray, spans: np.ndarray) -> list[tuple[int, int]]:
    """The parts of the text under the mask: token spans cut to the spans they touch, each character once.
    A token may touch several spans."""
    out: list[tuple[int, int]] = []
    for a, b in tokens[touched]:
        i = int(np.searchsorted(spans[:, 1], a, side="right"))
        while i < len(spans) and spans[i, 0] < b:
            lo, hi = max(int(a), int(spans[i, 0]), out[-1][1] if out else 0), min(int(b), int(spans[i, 1]))
            if lo < hi:
                out.append((lo, hi))
            i += 1
    return out


def formatted(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
              text_col: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """conv_id, formatted, token_ids, loss_mask (of the tokens), loss_starts and loss_ends (character ranges of ``formatted``)."""
    rows = conversations.select(F.col(f"`{conv_col}`").alias("conv"), F.struct(
        F.col(f"`{turn_col}`").alias("turn"), F.coalesce(F.col(f"`{role_col}`"), F.lit("")).alias("role"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")).alias("t"))
    whole = rows.groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("turns")).select(
        "conv", F.col("turns.role").alias("roles"), F.col("turns.text").alias("texts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer
        from tokenizers.processors import ByteLevel

        coder = Tokenizer.from_file(tokenizer)
        coder.encode_special_tokens = True
        coder.post_processor = ByteLevel(trim_offsets=False)
        for batch in batches:
            for at in range(0, batch.num_rows, 16):
                part = batch.slice(at, 16)
                out = []
                for conv, roles, texts in zip(*(c.to_pylist() for c in part.columns)):
                    text, spans = rendered(list(zip(roles, texts)))
                    code = coder.encode(text, add_special_tokens=False)
                    tokens = np.array(code.offsets, np.int64).reshape(-1, 2)
                    touched, _ = masked(tokens, spans)
                    cut = loss_spans(tokens, touched, spans)
                    out.append((conv, text, code.ids, touched.tolist(), [a for a, _ in cut], [b for _, b in cut]))
                cols = list(zip(*out))
                kinds = [part.schema.field(0).type, pa.string(), pa.list_(pa.int32()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.list_(pa.int64())]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)],
                                      names=["conv", "formatted", "token_ids", "loss_mask", "loss_starts", "loss_ends"])

    kind = whole.schema["conv"].dataType.simpleString()
    return whole.mapInArrow(run, f"conv {kind}, formatted string, token_ids array<int>, loss_mask array<boolean>, "
                                 "loss_starts array<long>, loss_ends array<long>").withColumnRenamed("conv", conv_col)


def digests(chats: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Read back from the formatted text: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, text, starts, ends in zip(*(c.to_pylist() for c in batch.columns)):
                turns = parsed(text)
                loss = unescaped("".join(text[a:b] for a, b in zip(starts, ends)))
                out.append((conv, len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(),
                            len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            if out:
                kinds = [batch.schema.field(0).type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kinds)],
                                      names=["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    kind = chats.schema[conv_col].dataType.simpleString()
    return chats.select(conv_col, "formatted", "loss_starts", "loss_ends").mapInArrow(
        run, f"conv {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    ).withColumnRenamed("conv", conv_col)
