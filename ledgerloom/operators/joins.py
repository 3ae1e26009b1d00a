"""Existence, exclusion and key joins.

Right sides are reduced to distinct keys first: a hot key then arrives as one
row per map task, and the left side never fans out. What stays skewed on the
left is split by adaptive execution; nothing is broadcast by hint here, because
no side has a proven bound.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distinct_keys(df: DataFrame, keys: Sequence[str] | str) -> DataFrame:
    return df.select(*([keys] if isinstance(keys, str) else keys)).distinct()


def exclude_keys(df: DataFrame, other: DataFrame, keys: Sequence[str] | str) -> DataFrame:
    """Rows of ``df`` without a partner in ``other``; null keys are kept."""
    on = [keys] if isinstance(keys, str) else list(keys)
    return df.join(distinct_keys(other, on), on, "left_anti").select(*df.columns)


def flag_exists(
    df: DataFrame, other: DataFrame, keys: Sequence[str] | str, flag: str
) -> DataFrame:
    """``df`` plus a boolean telling whether its key occurs in ``other``."""
    on = [keys] if isinstance(keys, str) else list(keys)
    present = distinct_keys(other, on).withColumn(flag, F.lit(True))
    return df.join(present, on, "left").select(
        *df.columns, F.coalesce(flag, F.lit(False)).alias(flag)
    )
