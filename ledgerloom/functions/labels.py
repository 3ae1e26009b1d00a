"""Ordered-rule labels and recodes."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.predicates import contains_any, nan_to_null


def _chain(branches: Sequence[tuple[Column, object]], default: object) -> Column:
    out = None
    for test, value in branches:
        out = F.when(test, value) if out is None else out.when(test, value)
    return F.lit(default) if out is None else out.otherwise(default)


def keyword_class(
    col: Column,
    rules: Sequence[tuple[str, Sequence[str]]],
    default: str = "Other",
    whole_word: bool = False,
) -> Column:
    """First rule with a keyword inside the text wins, ignoring case.

    Keywords match inside words unless ``whole_word`` is set. A rule without
    keywords never matches.
    """
    text = F.lower(col)
    branches = []
    for label, words in rules:
        if not words:
            continue
        if whole_word:
            test = text.rlike(r"\b(" + "|".join(re.escape(w.lower()) for w in words) + r")\b")
        else:
            test = contains_any(text, [w.lower() for w in words])
        branches.append((test, label))
    return _chain(branches, default)


def size_bin(col: Column, cuts: Sequence[tuple[object, str]], lowest: str) -> Column:
    """``cuts`` are (inclusive lower bound, label); null and NaN fall to ``lowest``."""
    col = nan_to_null(col)
    ordered = sorted(cuts, key=lambda c: c[0], reverse=True)
    return _chain([(col >= F.lit(bound), label) for bound, label in ordered], lowest)


def place_class(
    col: Column,
    home: str,
    near: Sequence[str],
    labels: tuple[str, str, str] = ("home", "near", "other"),
    normalize: bool = False,
) -> Column:
    """Home, listed near place, or other. ``normalize`` compares in lower case."""
    if normalize:
        col, home, near = F.lower(col), home.lower(), [n.lower() for n in near]
    return _chain([(col == home, labels[0]), (col.isin(list(near)), labels[1])], labels[2])


def type_code(col: Column, codes: Sequence[str] = ("835", "837")) -> Column:
    """First code, in the order given, found inside the text; null if none."""
    return _chain([(col.contains(c), c) for c in codes], None)


def same_type_label(a: Column, b: Column, same: str, different: str) -> Column:
    return F.when(a.cast("string").eqNullSafe(b.cast("string")), same).otherwise(different)


def override_where(col: Column, other: Column, phrase: str, value: str) -> Column:
    """``value`` wherever ``other`` contains the phrase, else unchanged."""
    return F.when(other.contains(phrase), value).otherwise(col)


def replace_values(col: Column, mapping: Mapping[str, str]) -> Column:
    """Exact replacement of listed values; everything else is kept."""
    return _chain([(col == old, new) for old, new in mapping.items()], col)


def bool_text(col: Column) -> Column:
    """``True`` / ``False`` text, capitalised."""
    return F.initcap(col.cast("string"))


def binary_label(col: Column, positive: str) -> Column:
    """1 for the positive value, 0 for any other, null stays null."""
    return F.when(col == positive, 1).when(col.isNotNull(), 0)


def signed_label(col: Column) -> Column:
    """0 becomes -1, everything else 1."""
    return F.when(col == 0, -1).otherwise(1)


def classify(p: Column, threshold: float = 0.3) -> Column:
    """1 where the probability reaches the threshold."""
    return (p >= threshold).cast("int")


def to_number(col: Column, kind: str = "double") -> Column:
    """Numeric value of the text, null where it is not a number."""
    return col.try_cast(kind)


def as_indicators(terms: Iterable[str]) -> dict[str, Column]:
    """Columns for model terms: ``name`` is numeric, ``name=level`` is 0 or 1."""
    out = {}
    for term in terms:
        name, eq, level = term.partition("=")
        out[term] = (F.col(name) == level).cast("double") if eq else F.col(name)
    return out
