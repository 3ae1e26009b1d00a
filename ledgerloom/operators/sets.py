"""Concatenation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stack(parts: Sequence[tuple[DataFrame, str]], label: str, measures: Sequence[str]) -> DataFrame:
    """Results with differently named label columns under one schema,
    duplicates kept. Each part is (frame, its label column)."""
    return stack_results(
        [df.select(F.col(own).alias(label), *measures) for df, own in parts]
    )


def stack_results(parts: Sequence[DataFrame]) -> DataFrame:
    """One union of all parts, matched by column name.

    Parts are paired up level by level: a chain over thousands of parts would be
    analyzed again, whole, at every link.
    """
    return _paired(parts, False)


def _paired(parts: Sequence[DataFrame], missing: bool) -> DataFrame:
    level = list(parts)
    while len(level) > 1:
        pairs = [level[i : i + 2] for i in range(0, len(level), 2)]
        level = [p[0].unionByName(p[1], missing) if len(p) == 2 else p[0] for p in pairs]
    return level[0]


def union_sources(sources: Mapping[str, DataFrame], source: str = "source_table") -> DataFrame:
    """Frames as one, matched by column name, with the name each row's frame has in
    ``sources``. Columns that a frame lacks are null there.

    The name is a constant within a frame, so a filter on it leaves the other frames
    unread. A frame that has a column of that name already is an error.
    """
    if not sources:
        raise ValueError("no frame to unite")
    clash = [name for name, df in sources.items() if source in df.columns]
    if clash:
        raise ValueError(f"a column {source!r} is there already: {clash}")
    return _paired([df.withColumn(source, F.lit(name)) for name, df in sources.items()], True)
