"""Words of texts for routing and retrieval."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NOT_WORD = r"[^\p{IsAlphabetic}\p{N}]+"


def word_list(text: Column) -> Column:
    """Letters and digits in order, ASCII letters lowered."""
    return F.array_remove(F.split(F.translate(text, _UPPER, _LOWER), _NOT_WORD), "")


def word_set(text: Column) -> Column:
    return F.array_distinct(word_list(text))
