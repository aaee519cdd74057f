"""Projections and filters of texts and nested fields."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def names_any(text: Column, words: Sequence[str]) -> Column:
    """Whether a text has one of the words as a whole word, in either case. The words are a fixed list of the caller's."""
    return F.coalesce(text.rlike(r"(?i)\b(" + "|".join(words) + r")\b"), F.lit(False))


def dotted(json: Column, path: str) -> Column:
    """The value at a.b.c of a JSON text; null if it isn't there."""
    return F.get_json_object(json, "$." + path)


def first_of(*columns: str) -> Column:
    """The first payload that is there: by name, in order."""
    return F.coalesce(*(F.col(c) for c in columns))
