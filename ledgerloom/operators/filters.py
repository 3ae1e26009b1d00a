"""Row filters and cohort tags."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.sources.frames import rows_to_df

MAX_LITERALS = 1_000  # default of the longest list that becomes an IN


def where_in(
    df: DataFrame, col: str, values: Sequence[object], max_literals: int = MAX_LITERALS
) -> DataFrame:
    """Rows whose value is in the list; null never is.

    Values are cast to the column's type as text or numbers are. Up to
    ``max_literals`` of them become an IN that reaches the scan, longer lists a
    join with the same result.
    """
    kind = df.schema[col].dataType
    listed = [v for v in dict.fromkeys(values) if v is not None]
    if len(listed) <= max_literals:
        return df.where(F.col(col).isin([F.lit(v).cast(kind) for v in listed]))
    by_type: dict[type, list[tuple[object]]] = {}
    for v in listed:
        by_type.setdefault(type(v), []).append((v,))
    keys = [
        df.sparkSession.createDataFrame(rows, [col]).select(F.col(col).cast(kind))
        for rows in by_type.values()
    ]
    return df.join(reduce(DataFrame.unionAll, keys), col, "left_semi").select(*df.columns)


def tag_cohort(
    df: DataFrame, cohorts: Mapping[str, Sequence[str]], key: str, name: str = "cohort"
) -> DataFrame:
    """One row per cohort the key belongs to; rows of no cohort are dropped, and a
    key listed twice in a cohort counts once.

    The pairs are literals of the call. Spark knows their size and broadcasts
    them if they fit its threshold; short lists also reach the scan as an IN.
    """
    pairs = [(k, c) for c, keys in cohorts.items() for k in dict.fromkeys(keys)]
    members = rows_to_df(df.sparkSession, pairs, f"`{key}` string, `{name}` string")
    return where_in(df, key, [k for k, _ in pairs]).join(members, key)


def in_years(df: DataFrame, ts: str, years: Sequence[int | str]) -> Column:
    """Prefix match against years, written on the raw column.

    A range (date, timestamp) or starts-with (text) on the stored column can be
    pushed to the scan and prune partitions; a test on a derived period cannot.
    """
    col, kind = F.col(ts), df.schema[ts].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        def first_day(y: int) -> Column:
            return F.lit(f"{y:04d}-01-01").cast(kind)

        tests = []
        for low, high in _runs(sorted({int(y) for y in years})):
            tests.append((col >= first_day(low)) & (col < first_day(high + 1)))
    else:
        tests = [col.startswith(str(y)) for y in years]
    return reduce(or_, tests) if tests else F.lit(False)


def _runs(years: list[int]) -> list[tuple[int, int]]:
    """Consecutive years merged into (first, last) runs."""
    runs: list[tuple[int, int]] = []
    for y in years:
        if runs and y == runs[-1][1] + 1:
            runs[-1] = (runs[-1][0], y)
        else:
            runs.append((y, y))
    return runs


def where_abs_over(df: DataFrame, col: str, threshold: float) -> DataFrame:
    return df.where(F.abs(col) > threshold)
