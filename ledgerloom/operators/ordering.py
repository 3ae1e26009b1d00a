"""Sorted and limited results; each limit is the feature asked for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def top_totals(df: DataFrame, measure: str, *ties: str) -> DataFrame:
    """Descending by measure, ties settled by the given columns."""
    return df.orderBy(F.desc(measure), *ties)


def first_rows(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    return df.orderBy(*order).limit(n)


def last_rows(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """Last ``n`` rows, given back in ascending order. The inner top-n keeps
    ``n`` rows per task, so nothing is sorted as a whole."""
    return df.orderBy(*[F.desc(c) for c in order]).limit(n).orderBy(*order)


def by_magnitude(df: DataFrame, col: str, *ties: str) -> DataFrame:
    return df.orderBy(F.desc(F.abs(col)), *ties)


def best_by(df: DataFrame, metric: str, order: Sequence[str]) -> DataFrame:
    """The row with the largest value, the first under ``order`` on ties, null
    values last."""
    return df.orderBy(F.desc_nulls_last(metric), *order).limit(1)
