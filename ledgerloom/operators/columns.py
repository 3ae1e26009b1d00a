"""Column-set operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import period
from ledgerloom.sources.frames import rows_to_df


def with_period(df: DataFrame, ts: str, grain: str, name: str = "period") -> DataFrame:
    """All columns plus the month or year key of ``ts``."""
    return df.withColumn(name, period(F.col(ts), grain))


def drop_matching(df: DataFrame, part: str) -> DataFrame:
    """Drop every column whose name contains ``part``."""
    return df.drop(*[c for c in df.columns if part in c])


def column_fill(df: DataFrame) -> DataFrame:
    """``(column_name, n_values)``: non-null count of each column, in one pass."""
    if not df.columns:
        return rows_to_df(df.sparkSession, [], "column_name string, n_values bigint")
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns])
    return counts.unpivot([], [F.col(f"`{c}`") for c in df.columns], "column_name", "n_values")


def drop_all_null(df: DataFrame) -> DataFrame:
    """Drop the columns that hold no value at all.

    Runs one aggregate over ``df``; what reaches the driver is a column name
    list. Not needed before an aggregate that names its columns: the scan reads
    only those anyway.
    """
    kept = {r.column_name for r in column_fill(df).where("n_values > 0").collect()}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c in kept])


def fill(df: DataFrame, value: object, cols: Sequence[str] | None = None) -> DataFrame:
    """Replace nulls by ``value`` in columns of a matching type."""
    return df.na.fill(value, subset=list(cols) if cols is not None else None)


def complete_cases(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows without a null in any model input."""
    return df.na.drop(subset=list(cols))


def as_factor(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Columns as text, which model formulas treat as categories in
    alphabetical level order."""
    return df.withColumns({c: F.col(c).cast("string") for c in cols})


def as_levels(df: DataFrame, col: str, levels: Sequence[object]) -> DataFrame:
    """Restrict a column to given levels; any other value becomes null."""
    return df.withColumn(col, F.when(F.col(col).isin(list(levels)), F.col(col)))
