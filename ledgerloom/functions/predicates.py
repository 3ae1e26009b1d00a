"""Boolean columns."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_blank(col: Column) -> Column:
    """Null or the empty string."""
    return col.isNull() | (col == "")


def is_populated(col: Column) -> Column:
    """Not null, not blank and not the text NaN. Never null itself.

    A text test on purpose: ``isnan`` on a string id casts it to double, which
    fails on ids such as ``A17`` under ANSI mode.
    """
    text = F.trim(col.cast("string"))
    return F.coalesce((text != "") & (F.lower(text) != "nan"), F.lit(False))


def contains_any(col: Column, words: Sequence[str]) -> Column:
    """Case-sensitive substring test against several words."""
    return reduce(or_, [col.contains(w) for w in words])


def contains_ci(col: Column, word: str) -> Column:
    """Case-insensitive substring test; the word is literal text."""
    return F.lower(col).contains(word.lower())


def is_crosswalk(col: Column, codes: Sequence[str] = ("835", "837"), word: str = "crosswalk") -> Column:
    """A code and the word, in either order."""
    any_code = "(" + "|".join(re.escape(c) for c in codes) + ")"
    return col.rlike(f"{any_code}.*{word}|{word}.*{any_code}")


def matches_param(col: Column, value: str) -> Column:
    """``LIKE '%value%'``: a blank value keeps every non-null row and ``%`` or
    ``_`` inside the value act as wildcards. Plain values fold to a pushed-down
    ``Contains``."""
    return col.like(f"%{value}%")


def nan_to_null(col: Column) -> Column:
    """NaN sorts above every number in Spark; null falls to the lowest bin."""
    return F.when(~F.isnan(col.cast("double")), col)
