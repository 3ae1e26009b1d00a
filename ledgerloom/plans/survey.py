"""Survey tables: shares by group and statistics of a subset."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.labels import binary_label
from ledgerloom.operators.columns import as_factor
from ledgerloom.operators.windows import share_overall, share_within


def prepare(
    df: DataFrame, label: str, positive: str, factors: Sequence[str], id_col: str = "row_id"
) -> DataFrame:
    """Raw survey rows ready for models: factors as text, the label as 1/0, and
    a hash of the answers as row id where there is none.

    Equal rows share such an id and so land in the same split and fold.
    """
    ready = as_factor(df, factors).withColumn(label, binary_label(F.col(label), positive))
    if id_col in df.columns:
        return ready
    return ready.withColumn(id_col, F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))


def preference_shares(
    df: DataFrame, group: str, label: str = "preference", within: bool = True
) -> DataFrame:
    """Share of each answer, of its group or of all rows."""
    return (share_within if within else share_overall)(df, group, label)


def subset_stats(
    df: DataFrame, group: str, value: str, label: str, positive: object, measure: str
) -> DataFrame:
    """One row about one group: percentage of positive answers, then mean and
    sample deviation of a measure over those. One scan serves all three."""
    hit = F.col(label) == positive
    kept = F.when(hit, F.col(measure))
    return df.where(F.col(group) == value).agg(
        F.try_divide(100 * F.count_if(hit), F.count(F.lit(1))).alias("percent"),
        F.avg(kept).alias("mean"),
        F.stddev_samp(kept).alias("sd"),
    )
